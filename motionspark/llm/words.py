"""Words of UTF-8 bytes, for operators that count or compare words of ASCII letters and of all other code points."""

from __future__ import annotations

from collections.abc import Iterator


def blanked(kept: bytes) -> bytes:
    """A table for ``bytes.translate``: A-Z become a-z, bytes of ``kept`` and of code points beyond ASCII stay, and all else
    becomes a blank."""
    stay = frozenset(kept)
    return bytes(x + 32 if 65 <= x <= 90 else x if x in stay or x >= 128 else 32 for x in range(256))


def pieces(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` bytes that are cut at blanks, so that no word is cut."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size) if at + size < len(raw) else -1
        end = len(raw) if end < 0 else end
        yield raw[at:end] if at or end < len(raw) else raw
        at = end
