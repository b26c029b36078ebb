import random
import sys

import pytest

from moraine.operators import codecs, tables
from moraine.testing import encoders

SAMPLES = [b"a", b"aaaa", b"aaaaa", b"\x90\x90\x90abc\x90", b"abab" * 300, bytes(range(256)) * 3, b"the quick brown fox " * 90 + b"z" * 1000, random.Random(3).randbytes(5000), b"\0" * 70_000]


@pytest.mark.parametrize("method", [1, 2, 3, 13, 14, 15])
@pytest.mark.parametrize("sample", range(len(SAMPLES)))
def test_round_trip(method, sample):
    plain = SAMPLES[sample]
    packed = encoders.ENCODERS[method](plain)
    assert codecs.decode(method, packed, len(plain), version5=True) == plain


def test_vectors():
    assert codecs.rle90(bytes.fromhex("419004900042"), 6) == b"AAAA\x90B"
    assert codecs.huffman(bytes.fromhex("50684a"), 4) == b"ABAB"


def test_lzw_with_clears():
    plain = b"the quick brown fox jumps " * 200
    assert codecs.lzw(encoders.lzw(plain, clear_after=37), len(plain)) == plain


def test_lz_huffman_shared_table_and_zero_window():
    plain = b"abcabcabc" * 50
    assert codecs.lz_huffman(encoders.lz_huffman(plain, share_table=True), len(plain)) == plain


def test_lz_huffman_predefined_tables_are_a_parameter():
    with pytest.raises(codecs.Unsupported):
        codecs.lz_huffman(b"\x10abc", 3)
    # One code of two symbols, "a" and "b", spelt out: bits 0, 1, 0.
    lengths = [0] * 321
    lengths[97] = lengths[98] = 1
    assert codecs.lz_huffman(b"\x10\x02", 3, [(lengths, lengths, [1])]) == b"aba"


def test_arsenic_blocks_and_randomization():
    plain = b"randomized blocks " * 400
    gaps = (5, 40, 7)
    packed = encoders.arsenic(plain, block_bits=10, gaps=gaps)
    assert codecs.arsenic(packed, len(plain), gaps) == plain
    with pytest.raises(codecs.Unsupported):
        codecs.arsenic(packed, len(plain))


@pytest.mark.parametrize("method", [1, 2, 3, 13, 14, 15])
def test_truncated_streams_are_bad_data(method):
    plain = b"some words, some more words, and the end" * 20
    packed = encoders.ENCODERS[method](plain)
    with pytest.raises(codecs.BadData):
        codecs.decode(method, packed[: len(packed) // 2], len(plain), version5=True)


def test_unknown_methods():
    for method in (5, 6, 8, 7, 14):
        with pytest.raises(codecs.Unsupported):
            codecs.decode(method, b"", 0)


def lines_run(call):
    """Lines of Python that a call runs: its work, whatever the machine."""
    count = 0

    def trace(frame, event, arg):
        nonlocal count
        count += event == "line"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        call()
    finally:
        sys.settrace(before)
    return count


WORDS = b" ".join(random.Random(11).choices([b"of", b"the", b"archive", b"member", b"fork", b"table", b"reads", b"with", b"code", b"length"], k=1500))


def predefined(plain, size=None):
    return encoders.predefined(plain, 3) if size is None else codecs.lz_huffman(plain, size, tables.CODE_SETS)


@pytest.mark.parametrize(
    ("encode", "decode", "most"),
    [
        (encoders.rle90, codecs.rle90, 1),
        (encoders.huffman, codecs.huffman, 8),
        (encoders.lz_huffman, codecs.lz_huffman, 30),
        (predefined, predefined, 15),
        (encoders.arsenic, codecs.arsenic, 38),
    ],
)
def test_lines_of_python_for_each_byte(encode, decode, most):
    packed = encode(WORDS)
    assert decode(packed, len(WORDS)) == WORDS
    assert lines_run(lambda: decode(encode(WORDS), len(WORDS))) < most * len(WORDS)


def test_forks_longer_than_what_is_looked_at_together():
    plain = random.Random(4).randbytes(70_000)
    for method in (2, 3, 13):
        assert codecs.decode(method, encoders.ENCODERS[method](plain), len(plain)) == plain


def test_lzw_is_not_read_code_by_code(monkeypatch):
    packed = encoders.lzw(WORDS)
    monkeypatch.setattr(codecs.LowBits, "take", None)
    assert codecs.lzw(packed, len(WORDS)) == WORDS
