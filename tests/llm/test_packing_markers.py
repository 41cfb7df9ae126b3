"""Markers of the tokenizer in texts of any case."""

import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from basewise.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("text", ["a <|ENDOFTEXT|> b", "Some <|StartOfText|>Words, AND<|endoftext|>.", "A <|b C|> D", "No Marker, HERE."])
def test_ids_of_markers(text):
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert packing.word_ids([text, text + " é"], PATH)[0] == struct.pack(f"<{len(ids)}I", *ids)
