import pytest

from moraine.functions.native import crc16_ibm_bytes
from moraine.operators import codecs, crypto, decode
from moraine.sources.parse import Fork
from moraine.testing import encoders


def fork(packed, plain, **more):
    return Fork(present=True, size=len(plain), compressed_size=len(packed), crc16=crc16_ibm_bytes(plain), **more)


@pytest.mark.parametrize("number", [1, 2, 3, 4, 5])
def test_predefined_sets_decode_by_default(number):
    first, second, distances = ({s: k for k, s in codecs.canonical(x).items()} for x in decode.Tables().code_sets[number - 1])
    # Every literal, a match of three bytes at distance 3, and a literal of the second code.
    steps = [(first, i) for i in range(256)] + [(first, 256), (distances, 2), (None, 0), (second, 97)]
    bits = "".join("0" if code is None else f"{code[s][1]:0{code[s][0]}b}" for code, s in steps)
    packed = bytes([number << 4]) + bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    plain = bytes(range(256)) + b"\xfd\xfe\xffa"
    assert decode.decode_fork(packed, fork(packed, plain, method=13))[:2] == ("ok", plain)


def test_codes_are_complete():
    for lengths in (x for codes in decode.Tables().code_sets for x in codes):
        assert sum(2.0**-n for n in lengths if n > 0) == 1


def test_randomized_blocks_decode_by_default():
    plain = b"randomized blocks of many bytes " * 2000
    packed = encoders.arsenic(plain, gaps=decode.Tables().gaps)
    assert len(decode.Tables().gaps) == 256
    assert decode.decode_fork(packed, fork(packed, plain, method=15, version5=True))[:2] == ("ok", plain)


def test_classic_cipher_decodes_by_default():
    boxes = decode.Tables().boxes
    assert all(sorted(box[16 * i : 16 * i + 16]) == list(range(16)) for box in boxes for i in range(4))
    cipher, plain, entry_key = crypto.ClassicCipher(boxes), b"sixteen bytes ok" * 9 + b"abc", bytes(range(16))
    archive_key = cipher.archive_key(b"password")
    start = b"abcd" + cipher.block(archive_key, b"abcd\0\0\0\4", True)[4:]
    mkey = cipher.block(archive_key, start, True)
    own = cipher.file_key(b"password", mkey, entry_key)
    a, b, c, d = (int.from_bytes(own[i : i + 4], "big") for i in (0, 4, 8, 12))
    padded, packed = plain + bytes(5), bytearray()
    for at in range(0, len(padded), 8):
        left, right = int.from_bytes(padded[at : at + 4], "big") ^ a ^ c, int.from_bytes(padded[at + 4 : at + 8], "big") ^ b ^ d
        packed += left.to_bytes(4, "big") + right.to_bytes(4, "big")
        c, d = d, crypto._rotate(left ^ right ^ a ^ b ^ d, 1)
    member = fork(bytes(packed), plain, encrypted=True, encryption="classic-des", classic_padding=5, mkey=mkey, entry_key=entry_key)
    assert decode.decode_fork(bytes(packed), member, "password")[:2] == ("ok", plain)
    assert decode.decode_fork(bytes(packed), member, "wrong")[0] == "password-bad"
    assert decode.decode_fork(bytes(packed), member)[0] == "password-required"
