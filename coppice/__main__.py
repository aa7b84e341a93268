import sys

from coppice.cli import main

sys.exit(main())
