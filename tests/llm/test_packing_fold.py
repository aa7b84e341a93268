"""Texts in lower case before they are split: the same ids, and fewer strings to learn."""

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from coppice.llm.packing import CLOSING_ID, VOCABULARY, Encoder  # noqa: E402

ODD = ["Über ÀÖØÞ ×÷ ß µ ª STRASSE", "A<|endoftext|>B <|STARTOFTEXT|> Word", "İstanbul ǅ ﬁ Σς K Å", "DON'T I'LL 12AB\x85C\xa0D \x1c\x1d E\tF\nG\r\nH", "ÉÉ éÉ", "", "   ", "[PAD] <PAD> #$% ABC."]


def test_folded_texts_have_the_same_ids():
    e = Encoder(public_tokenizers.path(VOCABULARY))
    found = [np.frombuffer(x, "<u4").tolist() for x in e.encode(ODD)]
    assert found == [e.tokenizer.encode(t, add_special_tokens=False).ids + [CLOSING_ID] for t in ODD]


def test_case_makes_no_further_strings():
    e = Encoder(public_tokenizers.path(VOCABULARY))
    one = e.encode(["Word WORD word wOrd."])
    assert set(e.chunks) == {"word", "word."} and one == e.encode(["word word word word."])
