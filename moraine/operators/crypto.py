"""Password ciphers of both archive versions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from moraine.operators.codecs import BadData

#: Length of keys and hashes of version 5.
V5_KEY = 5


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, value in enumerate(data):
        i = (i + 1) & 255
        j = (j + state[i]) & 255
        state[i], state[j] = state[j], state[i]
        out[n] = value ^ state[(state[i] + state[j]) & 255]
    return bytes(out)


def v5_password_key(password: str) -> bytes:
    return hashlib.md5(password.encode()).digest()[:V5_KEY]


def v5_archive_hash(password: str) -> bytes:
    return hashlib.md5(v5_password_key(password)).digest()[:V5_KEY]


def v5_decrypt(password: str, archive_hash: bytes, entry_key: bytes, data: bytes) -> bytes | None:
    """Plain bytes, or None for a wrong password. Encryption is the same operation."""
    if v5_archive_hash(password) != archive_hash:
        return None
    return rc4(v5_password_key(password) + entry_key, data)


# The classic format's block cipher is the Data Encryption Standard (FIPS 46-3) without its initial and final permutation and with a key
# schedule of its own: a round's 48 key bits are twelve of the key's sixteen hexadecimal digits. Bits are numbered as the
# standard prints them, from 1 at the left.
#: The standard's permutation P of what the boxes give.
PERMUTATION = (
    16, 7, 20, 21, 29, 12, 28, 17, 1, 15, 23, 26, 5, 18, 31, 10,
    2, 8, 24, 14, 32, 27, 3, 9, 19, 13, 30, 6, 22, 11, 4, 25,
)
#: The digits of the key that make up a round's key, counted from the digit with the round's number.
KEY_DIGITS = (1, 8, 5, 10, 3, 14, 6, 11, 2, 13, 0, 9)
#: Fixed value: the key and the first chain value of the password's hash.
_SEED = bytes.fromhex("0123456789abcdef")
_ROUNDS = 16


def _rotate(x: int, n: int) -> int:
    return (x >> n | x << 32 - n) & 0xFFFFFFFF


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b, strict=True))


class ClassicCipher:
    """Key derivation and stream of the classic format, over given substitution boxes."""

    def __init__(self, boxes: Sequence[Sequence[int]]):
        if len(boxes) != 8 or any(len(b) != 64 for b in boxes):
            raise ValueError("eight boxes of 64 entries")
        # What each six bits that enter a box add to the permuted word: the outer two choose the row.
        target = {source: place for place, source in enumerate(PERMUTATION, 1)}
        self.words = [
            [sum(1 << 32 - target[4 * n + k + 1] for k in range(4) if box[(six >> 4 & 2 | six & 1) * 16 + (six >> 1 & 15)] >> 3 - k & 1) for six in range(64)]
            for n, box in enumerate(boxes)
        ]

    def block(self, key: bytes, block: bytes, encrypt: bool) -> bytes:
        """One block of eight bytes; decryption takes the rounds' keys the other way round."""
        digits = key.hex()
        order = range(_ROUNDS) if encrypt else range(_ROUNDS - 1, -1, -1)
        left, right = int.from_bytes(block[:4], "big"), int.from_bytes(block[4:], "big")
        for n in order:
            round_key = int("".join(digits[(n + d) % 16] for d in KEY_DIGITS), 16)
            # The expansion: every four bits with the one before and the one after.
            ring = (right & 1) << 33 | right << 1 | right >> 31
            mixed = 0
            for at, words in enumerate(self.words):
                mixed |= words[(ring >> 28 - 4 * at ^ round_key >> 42 - 6 * at) & 63]
            left, right = right, left ^ mixed
        return right.to_bytes(4, "big") + left.to_bytes(4, "big")

    def archive_key(self, password: bytes) -> bytes:
        """The chained hash of the password, eight of its (seven-bit) characters at a time."""
        chain = _SEED
        for at in range(0, max(len(password), 1), 8):
            letters = bytes(c & 0x7F for c in password[at : at + 8])
            chain = self.block(_SEED, _xor(chain, letters.ljust(8, b"\0")), True)
        return chain

    def file_key(self, password: bytes, mkey: bytes, entry_key: bytes) -> bytes | None:
        """Key and start of the stream of one member, or None for a wrong password."""
        key = self.archive_key(password)
        master = self.block(key, mkey, False)
        # Half of the master key is a check value over the other half.
        if self.block(key, master[:4] + (4).to_bytes(4, "big"), True)[4:] != master[4:]:
            return None
        first = _xor(self.block(key, entry_key[:8], False), master)
        return first + self.block(first, entry_key[8:16], False)

    @staticmethod
    def stream(key: bytes, data: bytes, padding: int) -> bytes:
        """Plain bytes without the padding: each block is masked with the fixed half of the key and the running half."""
        if len(data) % 8 or padding > len(data):
            raise BadData("length of the ciphertext")
        low32 = 0xFFFFFFFF
        fixed, state = int.from_bytes(key[:8], "big"), int.from_bytes(key[8:16], "big")
        out = []
        for at in range(0, len(data), 8):
            cipher = int.from_bytes(data[at : at + 8], "big")
            plain = cipher ^ fixed ^ state
            out.append(plain.to_bytes(8, "big"))
            # The old right half moves to the left; the new one mixes it with the block and the fixed half.
            both = cipher ^ fixed
            state = (state & low32) << 32 | _rotate((both >> 32 ^ both ^ state) & low32, 1)
        return b"".join(out)[: len(data) - padding]
