"""Secrets in texts: a keyword automaton, anchored patterns near its hits only, then the checksums that tokens carry.

An Aho-Corasick automaton reads a text once and says where a keyword ends (password, AKIA, ghp_, ...). A pattern is tried
only there, anchored at the keyword's first letter; most texts hold no keyword, and no pattern runs over them. Runs of
hexadecimal digits have no keyword: every sixteenth byte is probed, as a run of 32 covers two neighbouring probes, and
only around such a pair is the run measured. Tokens that carry a checksum (GitHub, npm, extended private keys, Bech32
secret keys) count only if it holds; signed web tokens and PEM keys only if their contents decode to what they say they are.
All patterns are of ASCII, so texts are read as UTF-8 bytes and spans turned into code points at the end.

Kinds are the base ones (assign, access, hex), then the method's own. Matches of a base kind are leftmost and apart; a
match that is too short is dropped and nothing within it tried again. A token of the other kinds that fails its check is no match.

Defined cases: null text counts as empty; ill-formed UTF-8 is replaced by U+FFFD first; offsets are code points, end
exclusive; a null doc_id and repeated rows are rows like others; an empty table gives an empty result; other columns are
never read, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import text_rows

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "xprv", "bech32", "jwt", "pem")

# Words that name a secret, and how tokens of known issuers begin.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("AKIA",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
    "bech32": ("AGE-SECRET-KEY-1", "nsec1"),
    "jwt": ("eyJ",),
    "pem": ("-----BEGIN ",),
}
# What must follow from the keyword's first letter on. No pattern goes back over what it has read.
PATTERNS = {
    "assign": re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", re.I),
    "access": re.compile(rb"AKIA[A-Z0-9]++"),
    "github": re.compile(rb"gh[opurs]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "xprv": re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"),
    "bech32": re.compile(rb"(?:AGE-SECRET-KEY-1|nsec1)[A-Za-z0-9]{58}(?![A-Za-z0-9])"),
    "jwt": re.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.[A-Za-z0-9_-]*+"),
    "pem": re.compile(rb"-----BEGIN ([A-Z0-9 ]{0,40}+)(?<=PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END \1-----"),
}
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_HEX_RUN = re.compile(rb"[0-9a-f]++")
_STRIDE = LEAST_HEX // 2


def crc_holds(token: bytes) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    body, tail, n = token[-36:-6], token[-6:], 0
    for c in tail:
        n = 62 * n + _BASE62.index(c)
    return n == zlib.crc32(body)


def base58_holds(token: bytes) -> bool:
    """The last four bytes begin the double SHA-256 of those before."""
    n = 0
    for c in token:
        n = 58 * n + _BASE58.index(c)
    data = n.to_bytes((n.bit_length() + 7) // 8)
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def bech32_holds(token: bytes) -> bool:
    """The BCH code over prefix and data leaves 1."""
    low = token.lower()
    if token not in (low, token.upper()):
        return False
    prefix, _, data = low.rpartition(b"1")
    if any(c not in _BECH32 for c in data):
        return False
    left = 1
    for v in [*(c >> 5 for c in prefix), 0, *(c & 31 for c in prefix), *(_BECH32.index(c) for c in data)]:
        top, left = left >> 25, (left & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            if top >> i & 1:
                left ^= g
    return left == 1


def _from_base64(text: bytes) -> bytes:
    return base64.b64decode(text + b"=" * (-len(text) % 4), altchars=b"-_", validate=True)


def signed_token_holds(m: re.Match) -> bool:
    """The head is a JSON object that names an algorithm, the claims are a JSON object."""
    try:
        head, claims = (json.loads(_from_base64(part)) for part in m.groups())
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head and isinstance(claims, dict)


def private_key_holds(m: re.Match) -> bool:
    """The body is one DER sequence that fills it, or an OpenSSH key."""
    try:
        data = base64.b64decode(b"".join(m[2].split()), validate=True)
    except binascii.Error:
        return False
    if m[1].startswith(b"OPENSSH"):
        return data.startswith(b"openssh-key-v1\0")
    if len(data) < 2 or data[0] != 0x30:
        return False
    n = data[1] & 127 if data[1] & 128 else 0
    return len(data) == 2 + n + (int.from_bytes(data[2 : 2 + n]) if n else data[1])


CHECKS = {
    "assign": lambda m: len(m[1]) >= LEAST_VALUE,
    "access": lambda m: m.end() - m.start() >= LEAST_ACCESS,
    "github": lambda m: crc_holds(m[0]),
    "npm": lambda m: crc_holds(m[0]),
    "xprv": lambda m: base58_holds(m[0]),
    "bech32": lambda m: bech32_holds(m[0]),
    "jwt": signed_token_holds,
    "pem": private_key_holds,
}


@functools.cache
def _automaton():
    """Keywords in lower case, each with its kind and length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word.lower(), (kind, len(word)))
    found.make_automaton()
    return found


def hex_runs(data: bytes) -> list[tuple[int, int]]:
    if len(data) < LEAST_HEX:
        return []
    probes = _HEX[np.frombuffer(data, np.uint8)[_STRIDE - 1 :: _STRIDE]]
    out, done = [], 0
    for i in np.flatnonzero(probes[:-1] & probes[1:]).tolist():
        start = (i + 1) * _STRIDE - 1
        if start < done:
            continue
        while start > done and _HEX[data[start - 1]]:
            start -= 1
        done = _HEX_RUN.match(data, start).end()
        if done - start >= LEAST_HEX:
            out.append((start, done))
    return out


def byte_spans(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start, then kind as listed."""
    out = [(*s, "hex") for s in hex_runs(data)]
    done = dict.fromkeys(KINDS, 0)
    # One letter a byte, so that places in the folded text are places in data.
    for last, (kind, n) in _automaton().iter(data.lower().decode("latin-1")):
        start = last + 1 - n
        if start >= done[kind] and (m := PATTERNS[kind].match(data, start)):
            holds = CHECKS[kind](m)
            if holds or kind in BASE:
                done[kind] = m.end()
            if holds:
                out.append((start, m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def spans(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of a text in well-formed UTF-8."""
    found = byte_spans(data)
    if not found or data.isascii():
        return [(kind, a, b) for a, b, kind in found]
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(kind, int(before[a]), int(before[b])) for a, b, kind in found]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def _well_formed(data: bytes) -> bytes:
    return data if data.isascii() else data.decode("utf-8", "replace").encode()


def _scan(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])
    for batch in batches:
        found = [[{"kind": k, "start": a, "end": b, "base": k in BASE} for k, a, b in spans(_well_formed(t.as_py()))] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], schema=schema)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and spans (kind, start, end, base), by start, then kind as listed in KINDS."""
    return text_rows(docs, id_col, text_col).mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
