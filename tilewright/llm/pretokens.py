"""Splitting text before byte-pair merges, as a finite-state transducer run in parallel.

The split pattern of byte-level BPE vocabularies,

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

becomes a deterministic transducer with eight states.  Its input symbols hold
the one or two characters of look-ahead that the pattern needs; a transition
emits whether a piece starts at the character.  A long text is cut into chunks;
each chunk yields a map from any start state to its end state, the maps compose
in a parallel prefix scan, and then every chunk runs once from its true start
state.  All of it works on whole columns of chunks at once.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np

LETTER, NUMBER, OTHER, APOS2, APOS3, SPACE_BEFORE, GAP_BEFORE, GAP_RUN, RESET = range(9)
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_GAP, ONE_MORE, TWO_MORE = range(8)
N_SYMBOLS, N_STATES = 9, 8
#: Characters in a chunk.
WIDTH = 256
#: Unicode's White_Space characters.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _transitions() -> tuple[bytes, bytes]:
    """For each key ``state * N_SYMBOLS + symbol``: the next state times N_SYMBOLS, and whether a piece starts."""
    to = np.zeros((N_STATES, N_SYMBOLS), dtype=np.uint8)
    emits = np.zeros((N_STATES, N_SYMBOLS), dtype=bool)
    run_of = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}
    for state in range(N_STATES):
        for symbol in range(N_SYMBOLS):
            if symbol == RESET:
                after, start = CLOSED, False
            elif state == TWO_MORE:
                after, start = ONE_MORE, False
            elif state == ONE_MORE:
                after, start = CLOSED, False
            elif symbol in run_of:
                after = run_of[symbol]
                start = state not in (after, AFTER_SPACE)
            elif symbol in (APOS2, APOS3):
                joined = state in (IN_OTHER, AFTER_SPACE)
                after = IN_OTHER if joined else ONE_MORE if symbol == APOS2 else TWO_MORE
                start = not joined
            elif symbol == SPACE_BEFORE:
                after, start = AFTER_SPACE, True
            elif symbol == GAP_BEFORE:
                after, start = CLOSED, True
            else:
                after, start = IN_GAP, state != IN_GAP
            to[state, symbol], emits[state, symbol] = after, start
    fill = 256 - N_STATES * N_SYMBOLS
    return (to * np.uint8(N_SYMBOLS)).tobytes() + bytes(fill), emits.astype(np.uint8).tobytes() + bytes(fill)


TO, EMITS = _transitions()
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Letter, number, white space (GAP_RUN) or other, for every code point."""
    if not _CLASSES:
        kind = np.full(0x110000, OTHER, dtype=np.uint8)
        for lo in range(0, 0x110000, 0x1000):
            for cp in range(lo, lo + 0x1000):
                major = unicodedata.category(chr(cp))[0]
                if major == "L":
                    kind[cp] = LETTER
                elif major == "N":
                    kind[cp] = NUMBER
        kind[WHITE_SPACE] = GAP_RUN
        _CLASSES.append(kind)
    return _CLASSES[0]


def symbols(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """The transducer's input for each character; ``resets`` are separators between texts."""
    symbol = np.frombuffer(bytearray(points.tobytes().translate(classes()[:256].tobytes())), dtype=np.uint8) if points.dtype == np.uint8 else classes()[points]
    gap = symbol == GAP_RUN
    ends = np.ones(len(points) + 1, dtype=bool)  # white space, a separator or the end comes here
    ends[:-1] = gap
    ends[resets] = True
    lone = gap & ~ends[1:]
    symbol[lone] = GAP_BEFORE
    symbol[lone & (points == 0x20)] = SPACE_BEFORE
    symbol[resets] = RESET
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        padded = np.zeros(len(points) + 2, dtype=points.dtype)
        padded[:-2] = points
        one, two = padded[marks + 1], padded[marks + 2]
        pair = np.isin(one, [ord(c) for c in "stmd"])
        triple = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[marks[pair]] = APOS2
        symbol[marks[triple]] = APOS3
    return symbol


def starts_of(symbol: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character: chunk maps, prefix scan, then one run."""
    n = len(symbol)
    if not n:
        return np.zeros(0, dtype=bool)
    chunks = -(-n // WIDTH)
    padded = np.full(chunks * WIDTH, RESET, dtype=np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(chunks, WIDTH).T)

    # Where a chunk takes each of the states.
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None] * np.uint8(N_SYMBOLS), chunks, axis=1)
    for j in range(WIDTH):
        maps = np.frombuffer((maps + columns[j]).tobytes().translate(TO), dtype=np.uint8).reshape(N_STATES, chunks)
    maps = (maps // np.uint8(N_SYMBOLS)).T.copy()

    # Inclusive scan under composition: log2(chunks) steps.
    gap = 1
    while gap < chunks:
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].astype(np.intp), axis=1)
        gap *= 2
    state = np.empty(chunks, dtype=np.uint8)
    state[0] = CLOSED
    state[1:] = maps[:-1, CLOSED]

    state *= np.uint8(N_SYMBOLS)
    out = np.empty((WIDTH, chunks), dtype=bool)
    for j in range(WIDTH):
        key = (state + columns[j]).tobytes()
        out[j] = np.frombuffer(key.translate(EMITS), dtype=bool)
        state = np.frombuffer(key.translate(TO), dtype=np.uint8)
    return out.T.ravel()[:n]


@dataclass
class Pieces:
    """Pieces of several texts: byte ranges in ``data`` and the text each belongs to."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def pieces(texts: list[str]) -> Pieces:
    """Split every text into pieces; byte ranges refer to the joined UTF-8 ``data``."""
    joined = "\0".join(texts)
    data = joined.encode("utf-8", "replace")
    raw = np.frombuffer(data, dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text_ends = np.cumsum(lengths + 1) - 1  # characters; the separator stands there
    resets = text_ends[:-1]
    if len(raw) == len(joined):
        points, where = raw, None
    else:
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
        where = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    at = np.flatnonzero(starts_of(symbols(points, resets)))
    text = np.searchsorted(text_ends, at, side="right")
    ends = np.empty_like(at)
    ends[:-1] = at[1:]
    if len(at):
        last = np.append(text[1:] != text[:-1], True)
        ends[last] = text_ends[text[last]]
    if where is not None:
        at, ends = where[at], where[ends]
    return Pieces(data, at, ends, text)
