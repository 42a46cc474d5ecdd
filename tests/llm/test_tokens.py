"""Words that the tokenizer and its word memory could see differently."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quillframe.llm import tokens


def check(texts):
    path = tokens.default_tokenizer()
    encode, encoder = Tokenizer.from_file(path), tokens.WordEncoder(path)
    ids, ends = encoder(pa.array(texts))
    for text, got in zip(texts, np.split(ids, ends[:-1]), strict=True):
        want = [*encode.encode(text or "", add_special_tokens=False).ids, 1]
        assert got.tolist() == want, repr(text)


def test_letters_before_marks():
    odd = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and len(chr(i).lower()) > 1]
    latin = [chr(i) for i in range(0x20, 0x600)]
    texts = [f"{a}{c}{b}{m}" for c in odd + latin for a, b in (("", ""), ("ab", "cd"), ("A", "")) for m in (".", ",", "")]
    check(["ŞEHRİ.", "ŞEHRİ,", "İ.", *texts])
    check([" ".join(texts)])


def test_marks_and_blanks(spark):
    marks = [chr(i) for i in [*range(0x300, 0x370), 0x1AB0, 0x20D0, 0x200B, 0x200D, 0xA0, 0x2003, 0x85, 0xFEFF]]
    texts = [f"e{m}.{x}" for m in marks for x in ("", " a", "\na", "a")] + [f"a {m}b" for m in marks]
    check([*texts, None, "", " ", "\n", "a  b", "\x01", "a\x01b \x01 c", "<|endoftext|>", "a<|endoftext|>.", "\r\n\t", "don't. it's, 12.5, x…"])
    check(["word " * 50_000, "x" * 20_000])


def test_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 10)
    encoder = tokens.WordEncoder(tokens.default_tokenizer())
    first = [encoder(pa.array([f"w{i} a. b"]))[0].tolist() for i in range(30)]
    monkeypatch.setattr(tokens, "CACHE_WORDS", 10_000)
    assert first == [encoder(pa.array([f"w{i} a. b"]))[0].tolist() for i in range(30)]


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr(tokens, "GROUP_PARTS", 3)
    sizes = spark.createDataFrame([(i, i * i + 1) for i in range(11) if i != 4], "part int, n long")
    got = {r.part: r.offset for r in tokens._before(sizes).collect()}
    assert got == {i: sum(j * j + 1 for j in range(i) if j != 4) for i in range(11) if i != 4}
