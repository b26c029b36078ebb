"""Closed vocabularies of the archive tables: status, exit codes, wrappers, formats, methods, encryption."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and numbers that other tools read.
OK = "ok"
IO = "io"
INVALID_ARGUMENT = "invalid-argument"
UNSUPPORTED = "unsupported"
BAD_FORMAT = "bad-format"
CHECKSUM = "checksum"
PASSWORD_REQUIRED = "password-required"
PASSWORD_BAD = "password-bad"
SKIPPED = "skipped"
NO_MEMORY = "no-memory"

EXIT_CODES = {OK: 0, SKIPPED: 0, IO: 1, NO_MEMORY: 1, UNSUPPORTED: 2, BAD_FORMAT: 3, CHECKSUM: 3, PASSWORD_REQUIRED: 4, PASSWORD_BAD: 4, INVALID_ARGUMENT: 5}
WRAPPERS = ("raw", "macbinary", "applesingle", "appledouble", "binhex", "pe-sfx", "unknown")
FORMATS = ("sit-classic", "sit5", "sitx", "unknown")
METHODS = {0: "none", 1: "rle", 2: "compress", 3: "huffman", 5: "lzah", 6: "fixed-huffman", 8: "mw", 13: "lz+huffman", 14: "installer", 15: "arsenic"}
NORMALIZATIONS = ("none", "nfc", "nfd")
FORK_MODES = ("skip", "rsrc", "appledouble", "both", "native")
FINDER_MODES = ("skip", "sidecar")
COLLISIONS = ("skip", "overwrite", "rename")
#: Seconds from 1904 to 1970.
MAC_EPOCH = 2082844800


def exit_code(status: Column) -> Column:
    """Exit code of a status; 1 for one that is not in the vocabulary."""
    return F.coalesce(*[F.when(status == name, F.lit(code)) for name, code in EXIT_CODES.items()], F.lit(1))


def method_name(method: int, version5: bool = False) -> str:
    low = method & 0x0F
    if low == 14 and version5:
        return "deflate"
    return METHODS.get(low, "unknown")


def check_choice(name: str, value: str, choices: tuple[str, ...]) -> str:
    """The value, or a ValueError, which is the usage error of the command line."""
    if value not in choices:
        raise ValueError(f"{name} is one of {', '.join(choices)}, not {value!r}")
    return value
