"""The source-tree reader and the AST-directory writer."""
