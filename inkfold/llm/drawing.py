"""Drawings as sets of commands, shared by the near-copy operators.

A drawing command is a letter with its numbers as values. The commands of all paths of a text form a multiset; it is
held as a sorted array of 64-bit tokens, one a command: a hash of letter, numbers and the number of the repeat, so that
the overlap of two multisets is that of their token arrays. Reading order, spelling of numbers, spacing and attributes leave
no trace. Tokens of different commands are equal with a chance of 1 in 2**64.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers of at most so many decimals and of at most WHOLE digits before the point are held as they are, all others by a hash of their exact value.
DECIMALS, WHOLE = 6, 11
#: Characters of paths and rows that are worked on at once: bounds a worker's memory.
CHUNK = 1_000_000
ROWS = 50_000

_PATH_DATA = re.compile(r"""<path\b[^<>]*?(?<![\w:-])d\s*=\s*(?:"([^"<>]*)|'([^'<>]*))""", re.I)
_UNSIGNED = r"(?:\d++\.?+\d*+|\.\d++)(?:[eE][-+]?\d++)?+"
_NUMBER = re.compile(rf"[-+]?{_UNSIGNED}")
_ARCS = re.compile(r"[aA]((?:[^a-zA-Z]|(?<=[\d.])[eE](?=[-+]?\d))*)")
# The two flags of an arc are one digit each and may stand without a blank before what follows.
_ARC = re.compile(rf"([\s,]*{_UNSIGNED}[\s,]*{_UNSIGNED}[\s,]*[-+]?{_UNSIGNED}[\s,]*)([01])[\s,]*([01])([\s,]*[-+]?{_UNSIGNED}[\s,]*[-+]?{_UNSIGNED})")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))

_OTHER, _LETTER, _DIGIT, _DOT, _SIGN = range(5)
_KIND = np.zeros(256, np.uint8)
for _c in b"ABCDFGHIJKLMNOPQRSTUVWXYZabcdfghijklmnopqrstuvwxyz":
    _KIND[_c] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
_KIND[ord(".")] = _DOT
_KIND[list(b"-+")] = _SIGN
_KIND[0] = _LETTER  # ends a path; no command
_WRITTEN_OUT = np.zeros(256, bool)
_WRITTEN_OUT[list(b"aAeE+")] = True
_POWER = np.array([10**k for k in range(19)], np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _spaced(m: re.Match) -> str:
    """The numbers of an arc command with a blank around each flag."""
    out, at, inside = [m[0][0]], 0, m[1]
    while arc := _ARC.match(inside, at):
        out.append(f"{arc[1]} {arc[2]} {arc[3]} {arc[4]}")
        at = arc.end()
    return "".join(out) + inside[at:]


def _plain(data: str) -> str:
    """Path data with every number in plain digits: arc flags, exponents, signs and second dots are written out, and numbers of
    too many digits become one of ``WHOLE + DECIMALS`` digits that is a hash of their exact value."""

    def one(m: re.Match) -> str:
        sign, digits, exponent = Decimal(m[0]).as_tuple()
        text = "".join(map(str, digits)).lstrip("0")
        short = text.rstrip("0")
        exponent += len(text) - len(short)
        if not short:
            return " 0 "
        if exponent >= -DECIMALS and len(short) + exponent <= WHOLE:
            return f" {'-' * sign}{Decimal((0, tuple(map(int, short)), exponent)):f} "
        code = int.from_bytes(blake2b(f"{short}e{exponent}".encode(), digest_size=8).digest()) % 10 ** (WHOLE + DECIMALS)
        return f" {'-' * sign}{code // 10**DECIMALS}.{code % 10**DECIMALS:0{DECIMALS}d} "

    return _NUMBER.sub(one, _ARCS.sub(_spaced, data))


def path_data(text: str | None) -> list[str]:
    """The ``d`` of every path, the last one also if it is cut off."""
    return [a or b for a, b in _PATH_DATA.findall(text)] if text else []


def in_order(row: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """The order by row (below 65,536), then by the values, the first of which are of 16 bits and the last of any kind."""
    order = np.argsort(values[-1])
    for small in (*values[-2::-1], row):
        order = order[np.argsort(small[order].astype(np.uint16), kind="stable")]
    return order


def _odd(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Which of the joined texts may have arcs, exponents, plus signs, second dots or numbers of too many digits."""
    buf = np.frombuffer(data, np.uint8)
    if not len(buf):
        return np.zeros(0, np.int64)
    at = [np.flatnonzero(_WRITTEN_OUT[buf])]
    inside = np.concatenate(([0], (_KIND[buf] == _DIGIT).view(np.int8), [0]))
    begin, end = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    if len(begin):
        dotted = buf[np.maximum(begin - 1, 0)] == ord(".")
        many = end - begin > np.where(dotted, DECIMALS, WHOLE)
        again = dotted & (buf[np.minimum(end, len(buf) - 1)] == ord(".")) & (end < len(buf))
        at.append(begin[many | again])
    dots = np.flatnonzero(buf == ord("."))
    at.append(dots[:-1][np.diff(dots) == 1])
    return np.unique(np.searchsorted(ends, np.concatenate(at), side="right") - 1)


def _commands(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the commands of joined path data: where each begins, its hash and its number of numbers."""
    buf = np.frombuffer(data, np.uint8)
    kind = _KIND[buf]
    letters = np.flatnonzero(kind == _LETTER)
    inside = kind >= _DIGIT
    before = np.concatenate(([False], inside[:-1]))
    start = inside & (~before | (kind == _SIGN))
    at = np.flatnonzero(inside)
    number = np.cumsum(start[at]) - 1
    first = at[start[at]]
    kinds = kind[at]
    dots = at[kinds == _DOT]
    ends = np.concatenate((np.flatnonzero(np.diff(number)), [len(at) - 1])) if len(at) else np.zeros(0, np.int64)
    point = at[ends] + 1 if len(at) else np.zeros(0, np.int64)
    point[number[kinds == _DOT]] = dots
    digit = kinds == _DIGIT
    where, of = at[digit], number[digit]
    rank = point[of] - where
    power = np.clip(np.where(rank > 0, rank - 1, rank) + DECIMALS, 0, 18)
    value = np.zeros(len(first), np.int64)
    if len(of):
        new = np.concatenate(([True], of[1:] != of[:-1]))
        value[of[new]] = np.add.reduceat((buf[where] - ord("0")).astype(np.int64) * _POWER[power], np.flatnonzero(new))
    value = np.where(buf[first] == ord("-"), -value, value) if len(first) else value
    owner = np.searchsorted(letters, first, side="right") - 1
    kept = owner >= 0
    value, owner = value[kept], owner[kept]
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    parts = mix(value.astype(np.uint64) * _MIX[2] + (nth.astype(np.uint64) + np.uint64(1)) * _MIX[1])
    sums, many = np.zeros(len(letters), np.uint64), np.zeros(len(letters), np.int64)
    if len(owner):
        new = np.concatenate(([True], owner[1:] != owner[:-1]))
        sums[owner[new]] = np.add.reduceat(parts, np.flatnonzero(new))
        many[owner[new]] = np.diff(np.concatenate((np.flatnonzero(new), [len(owner)])))
    code = mix(sums + (buf[letters].astype(np.uint64) * np.uint64(64) + many.astype(np.uint64)) * _MIX[0])
    real = buf[letters] != 0
    return letters[real], code[real], many[real]


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, tokens)``: the sorted tokens of each text, joined. At most 65,535 texts."""
    found = [path_data(t) for t in texts]
    data = [("\0".join(p) + "\0").encode("ascii", "replace") if p else b"" for p in found]
    whole = b"".join(data)
    odd = _odd(whole, np.cumsum([0, *map(len, data)]))
    if len(odd):
        for k in odd.tolist():
            data[k] = _plain(data[k].decode("ascii")).encode("ascii")
        whole = b"".join(data)
    at, code, _ = _commands(whole)
    offsets = np.searchsorted(at, np.cumsum([0, *map(len, data)]))
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if not len(row):
        return offsets, code.astype(np.int64)
    code = code[in_order(row, code)]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))
    repeat = np.arange(len(row)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    token = np.where(repeat == 0, code, mix(code + mix(repeat.astype(np.uint64)))).view(np.int64)
    return offsets, token[in_order(row, token)]


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= CHUNK or k + 1 - begin >= ROWS:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def parities(offsets: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two numbers: each token turns one bit. A bit that differs between two sets is a token that
    only one of them has, so the differing bits never outnumber the tokens not shared."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    if len(full):
        at = mix(tokens.view(np.uint64) ^ _MIX[2]) >> np.uint64(57)
        bit = np.uint64(1) << (at & np.uint64(63))
        for k in range(2):
            out[full, k] = np.bitwise_xor.reduceat(np.where(at >> np.uint64(6) == k, bit, np.uint64(0)), offsets[full])
    return out.view(np.int64)


def drawings(rows: DataFrame, output: str, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``n`` (commands), ``print`` (16 bytes, equal for equal multisets), ``p0`` and ``p1`` (parity
    bits) and ``tokens``.

    Rows whose text is null or has no command are left out. Text is read as a whole, however long.
    """
    kept = rows.select(*keep, output)
    fields = [f"`{c}` {t}" for c, t in kept.select(*keep).dtypes]
    schema = ", ".join([*fields, "n int", "print binary", "p0 bigint", "p1 bigint", "tokens array<bigint>"])
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(width).to_pylist()
            for part in _chunks(texts):
                offsets, token = tokens_of(texts[part])
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                marks = token.view(np.uint64)
                one = np.add.reduceat(mix(marks), offsets[full])
                two = np.add.reduceat(mix(marks ^ _MIX[0]), offsets[full])
                prints = np.stack((one, two), axis=1).tobytes()
                take = pa.array(full + part.start)
                columns = [batch.column(k).take(take) for k in range(width)]
                parity = parities(offsets, token)[full]
                columns += [pa.array(n[full].astype(np.int32)), pa.Array.from_buffers(pa.binary(16), len(full), [None, pa.py_buffer(prints)]).cast(pa.binary()), pa.array(parity[:, 0].copy()), pa.array(parity[:, 1].copy()), lists(n[full], token)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n", "print", "p0", "p1", "tokens"])

    return kept.mapInArrow(run, schema)


def lists(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """Joined values as an Arrow array of lists of these lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values))
