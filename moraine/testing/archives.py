"""Archives of both versions, wrappers and ciphers, byte by byte, for tests and for the registered queries."""

from __future__ import annotations

import binascii
import struct
from dataclasses import dataclass

from moraine.functions.native import crc16_ibm_bytes
from moraine.operators import crypto
from moraine.sources import detect, wrappers
from moraine.testing.encoders import ENCODERS


@dataclass
class Member:
    """A file with its forks; ``path`` may have folders."""

    path: str
    data: bytes = b""
    resource: bytes = b""
    method: int = 0
    file_type: bytes = b"TEXT"
    creator: bytes = b"ttxt"
    flags: int = 0
    created: int = 3061152000
    modified: int = 3758308646
    #: The data fork as it is to be stored, if it is encoded already.
    packed: bytes | None = None


def _packed(member: Member, payload: bytes) -> tuple[int, bytes]:
    """Method and bytes of a fork; empty ones are stored."""
    if payload and member.packed is not None and payload is member.data:
        return member.method, member.packed
    return (member.method, ENCODERS[member.method](payload)) if payload else (0, b"")


def classic(members: list[Member]) -> bytes:
    """A classic archive without folders."""
    body = b""
    for m in members:
        name = m.path.encode("mac_roman")
        (rmethod, rsrc), (dmethod, data) = _packed(m, m.resource), _packed(m, m.data)
        head = struct.pack(">BBB63s4s4sH6I2H", rmethod, dmethod, len(name), name, m.file_type, m.creator, m.flags, m.created, m.modified, len(m.resource), len(m.data), len(rsrc), len(data), crc16_ibm_bytes(m.resource), crc16_ibm_bytes(m.data))
        head += bytes(6)
        body += head + struct.pack(">H", crc16_ibm_bytes(head)) + rsrc + data
    return struct.pack(">4sHI4s8s", b"SIT!", len(members), len(body) + 22, b"rLau", b"\x01") + body


def v5(members: list[Member], password: str | None = None) -> bytes:
    """A version 5 archive; folders come from the members' paths, each before its members."""
    flags = 0x10 | (0x80 if password is not None else 0)
    head = b"StuffIt (c)1997-".ljust(80, b"\0") + bytes([0, 0, 5, flags])
    extra = bytes(14) + (b"\x05" + crypto.v5_archive_hash(password) if password is not None else b"")
    first = 100 + len(extra)
    body, offsets = b"", {"": 0}
    tree: dict[str, list] = {"": []}
    for m in members:
        parts = m.path.split("/")
        for i in range(1, len(parts)):
            folder, above = "/".join(parts[:i]), "/".join(parts[: i - 1])
            if folder not in tree:
                tree[folder] = []
                tree[above].append(folder)
        tree["/".join(parts[:-1])].append(m)

    def fork(m: Member, payload: bytes, at: int) -> tuple[int, bytes, bytes]:
        method, packed = _packed(m, payload)
        if password is None or not payload:
            return method, packed, b""
        key = struct.pack(">IB", at & 0xFFFFFFFF, len(payload) & 255)
        return method, crypto.rc4(crypto.v5_password_key(password) + key, packed), key

    def put(item, above: str) -> None:
        nonlocal body
        at = first + len(body)
        folder = isinstance(item, str)
        name = (item if folder else item.path).rsplit("/", 1)[-1].encode("mac_roman")
        m = Member(item) if folder else item
        method, data, key = (0, b"", b"") if folder else fork(m, m.data, at)
        rmethod, rsrc, rkey = (0, b"", b"") if folder else fork(m, m.resource, at + 1)
        crypted = password is not None and not folder
        tail = struct.pack(">H", len(tree[item])) if folder else bytes([method, len(key)]) + key
        header = 46 + len(tail) + len(name)
        body += struct.pack(">IBBHBB5I2H2I2H", 0xA5A5A5A5, 1, 0, header, 0, (0x40 if folder else 0) | (0x20 if crypted else 0), m.created, m.modified, 0, 0, offsets[above], len(name), 0, len(m.data), len(data), crc16_ibm_bytes(m.data), 0)
        body += tail + name + struct.pack(">HH4s4sH", 1 if m.resource else 0, 0, m.file_type, m.creator, m.flags) + bytes(22)
        if m.resource:
            body += struct.pack(">IIHHBB", len(m.resource), len(rsrc), crc16_ibm_bytes(m.resource), 0, rmethod, len(rkey)) + rkey
        body += rsrc + data
        if folder:
            offsets[item] = at
            for child in tree[item]:
                put(child, item)

    for item in tree[""]:
        put(item, "")
    head += struct.pack(">II", first + len(body), 0) + struct.pack(">HI", len(tree[""]), first) + bytes(2)
    return head[:100] + extra + body


def macbinary(payload: bytes, name: bytes = b"archive.sit", resource: bytes = b"", version: int = 2) -> bytes:
    head = bytearray(128)
    head[1 : 2 + len(name)] = bytes([len(name)]) + name
    head[65:73] = b"SIT!SIT!"
    head[83:91] = struct.pack(">II", len(payload), len(resource))
    if version == 3:
        head[102:106] = b"mBIN"
    if version >= 2:
        head[124:126] = struct.pack(">H", binascii.crc_hqx(bytes(head[:124]), 0))
    pad = lambda b: b + bytes(-len(b) % 128)
    return bytes(head) + pad(payload) + pad(resource)


def apple(payload: bytes, resource: bytes = b"", double: bool = False, little: bool = False) -> bytes:
    parts = [(1, payload), *([(2, resource)] if resource else [])]
    order = "<" if little else ">"
    magic = detect.APPLE_MAGICS["appledouble" if double else "applesingle"][little]
    out, at = struct.pack(">II16s", magic, 0x00020000, b"") + struct.pack(order + "H", len(parts)), 26 + 12 * len(parts)
    for ident, part in parts:
        out += struct.pack(order + "3I", ident, at, len(part))
        at += len(part)
    return out + b"".join(p for _, p in parts)


def binhex(payload: bytes, name: bytes = b"archive.sit", resource: bytes = b"", file_type: bytes = b"SIT!", creator: bytes = b"SIT!") -> bytes:
    sealed = lambda b: b + struct.pack(">H", binascii.crc_hqx(b, 0))
    head = bytes([len(name)]) + name + b"\0" + file_type + creator + struct.pack(">HII", 0, len(payload), len(resource))
    plain = sealed(head) + sealed(payload) + sealed(resource)
    out, at = bytearray(), 0
    while at < len(plain):
        run = 1
        while run < 255 and at + run < len(plain) and plain[at + run] == plain[at]:
            run += 1
        one = b"\x90\x00" if plain[at] == 0x90 else plain[at : at + 1]
        out += one + bytes([0x90, run]) if run > 3 else one * run
        at += run
    bits = len(out)
    coded = binascii.b2a_base64(bytes(out) + bytes(-bits % 3), newline=False)[: -(-bits * 8 // 6)]
    text = b":" + coded.translate(bytes.maketrans(wrappers._BASE64, wrappers.ALPHABET)) + b":"
    lines = b"\r".join(text[i : i + 64] for i in range(0, len(text), 64))
    return detect.BINHEX_MARK + b" 4.0)\r" + lines + b"\r"
