"""Token counts without encoding: a byte-pair tokenizer compiled to transducers.

Two deterministic transducers run one after the other (operator 4).

* The first splits a text into pieces (``pretokens``): chunk maps from start
  state to end state compose through a parallel prefix scan.
* The second reads the bytes of a piece.  A state holds what the rest of the
  encoding can still depend on: the longest suffix that starts some token, and
  for each such start the merges that could still cross it and by how much the
  count there differs.  A transition is annotated with the change of the token count, so a
  text's count is the sum of the annotations.  States are determinised when
  they are first reached and kept in flat numpy tables; all pieces of a batch
  step through them together.

Null and empty texts have no tokens.  Special strings inside a text are one
token each, as the library has it.  Rows are independent: repeated rows and
null ids come back as they are, and no column but id and text is read.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab as vocabs
from .common import frees, table, text_column, text_steps
from .pretokens import pieces

#: States after which the tables start anew (they are a cache; results do not depend on it).
MAX_STATES = 120_000
#: Bytes of pieces between two looks at that bound.
SLICE = 262_144
#: Bytes of a piece that step beside other pieces; the rest of longer pieces is cut into chunks.
TOGETHER, CHUNK = 96, 64
#: How far before a chunk the states of its domain begin.
BACK = np.array([64, 61, 47, 32])


class Counter:
    """The byte transducer, compiled as far as texts have needed it."""

    def __init__(self, vocab: vocabs.Vocab):
        self.vocab = vocab
        self.sorted = sorted(vocab.token_of)
        self.heads = {t[:k] for t in self.sorted for k in range(len(t))}
        self._clear()

    def _clear(self) -> None:
        self.kinds: dict[tuple, int] = {(): 0}
        self.kind: list[dict[int, int]] = [{}]
        self.narrowed: dict[tuple[int, bytes], int] = {}
        start = (b"", ((0, 0, 0),))
        self.states = [start]
        self.number = {start: 0}
        self.to = np.full((1024, 256), -1, dtype=np.int32)
        self.add = np.zeros((1024, 256), dtype=np.int8)

    def _known(self, met: dict[int, int]) -> int:
        key = tuple(sorted(met.items()))
        number = self.kinds.get(key)
        if number is None:
            number = self.kinds[key] = len(self.kind)
            self.kind.append(met)
        return number

    def _narrow(self, border: int, head: bytes) -> int:
        """Of the merges that may cross a border, those that tokens beginning with ``head`` meet.

        -1 if they keep all such tokens away.
        """
        known = self.narrowed.get((border, head))
        if known is None:
            vocab = self.vocab
            met = {l: m for l, m in self.kind[border].items() if (b := vocab.bytes_of[l]).startswith(head) or head.startswith(b)}
            known = self._known(met)
            if met:
                begin = bisect.bisect_right(self.sorted, head)
                end = bisect.bisect_left(self.sorted, head + b"\xff" * vocab.longest, begin)
                if end - begin <= 64 and not any(all(met.get(l, vocabs.UNKNOWN) > taken for l, taken in vocab.left[vocab.token_of[t]]) for t in self.sorted[begin:end]):
                    known = -1
            self.narrowed[border, head] = known
        return known

    def _compile(self, state: int, byte: int) -> None:
        vocab, kind = self.vocab, self.kind
        suffix, starts = self.states[state]
        grown = suffix + bytes((byte,))
        n = len(suffix)
        for k, border, count in starts:  # longest first
            token = vocab.token_of.get(grown[n - k :])
            if token is not None:
                met = kind[border]
                if not met or all(met.get(l, vocabs.UNKNOWN) > taken for l, taken in vocab.left[token]):
                    change = count + 1
                    break
        else:
            raise ValueError("no token fits: not a byte-level vocabulary")
        kept = []
        for k, border, count in starts:
            head = grown[n - k :]
            if head in self.heads:
                if border and (border := self._narrow(border, head)) < 0:
                    continue
                kept.append((k + 1, border, count - change))
        kept.append((0, self._known(vocab.threats(token)), 0))
        after = (grown[len(grown) - kept[0][0] :], tuple(kept))
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
            if number >= len(self.to):
                self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                self.add = np.concatenate([self.add, np.zeros_like(self.add)])
        self.to[state, byte] = number
        self.add[state, byte] = change

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = self.to[state, byte]
        if (missing := np.flatnonzero(after < 0)).size:
            for key in np.unique(state[missing].astype(np.int64) << 8 | byte[missing]).tolist():
                self._compile(key >> 8, key & 255)
            after = self.to[state, byte]
        return after, self.add[state, byte]

    def counts(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of tokens in each piece of ``data``."""
        out, at = np.zeros(len(starts), dtype=np.int64), 0
        reach = np.cumsum(ends - starts)
        while at < len(starts):  # the bound on states holds between slices
            if len(self.states) > MAX_STATES:
                self._clear()
            to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + SLICE, side="right")))
            out[at:to] = self._slice(data, starts[at:to], ends[at:to])
            at = to
        return out

    def _slice(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(data, dtype=np.uint8)
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        at, lengths = starts[order], lengths[order]
        total = np.zeros(len(order), dtype=np.int64)
        state = np.zeros(len(order), dtype=np.int32)
        longest = int(lengths[0]) if len(lengths) else 0
        # how many pieces are longer than p
        reach = np.searchsorted(-lengths, -np.arange(min(longest, TOGETHER)), side="left")
        for p, live in enumerate(reach.tolist()):
            state[:live], change = self._step(state[:live], raw[at[:live] + p])
            total[:live] += change
        long = int(np.searchsorted(-lengths, -TOGETHER, side="left"))
        if long:
            total[:long] += self._chunked(raw, at[:long] + TOGETHER, at[:long] + lengths[:long], state[:long])
        out = np.empty_like(total)
        out[order] = total
        return out

    def _run(self, raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of bytes take their states, and the tokens they add."""
        state, total = state.copy(), np.zeros(len(state), dtype=np.int64)
        for p in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > p)
            state[live], change = self._step(state[live], raw[begins[live] + p])
            total[live] += change
        return state, total

    def _chunked(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The tokens that the rests of long pieces add, each from its state.

        The rests are cut into chunks.  A chunk's map takes each state of its domain to an end
        state and a count.  The domain is where the start state gets over the bytes before the
        chunk, from ``len(BACK)`` places: the machine forgets its past within a few tokens.  The maps
        compose in a prefix scan; a chunk whose true state lies outside its domain is run on its own.
        """
        chunks = -(-(ends - begins) // CHUNK)
        piece = np.repeat(np.arange(len(begins)), chunks)
        last = np.cumsum(chunks) - 1
        first = last - chunks + 1
        at = begins[piece] + (np.arange(len(piece)) - first[piece]) * CHUNK
        size = np.minimum(CHUNK, ends[piece] - at)
        width = len(BACK)
        back = np.tile(BACK, len(at))
        domain, _ = self._run(raw, np.repeat(at, width) - back, back, np.zeros(len(back), dtype=np.int32))
        domain = domain.reshape(-1, width)
        domain[first] = state[:, None]
        end, count = self._run(raw, np.repeat(at, width), np.repeat(size, width), domain.ravel())
        end, count = end.reshape(-1, width), count.reshape(-1, width)
        # The place of each end state in the next chunk's domain; ``width`` if it has none.
        maps = np.full((len(at), width + 1), width, dtype=np.intp)
        same = end[:-1, :, None] == domain[1:, None, :]
        maps[:-1, :width] = np.where(same.any(2), same.argmax(2), width)
        maps[last] = 0  # the next piece starts from its own state
        gap = 1
        while gap < len(maps):
            maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap], axis=1)
            gap *= 2
        place = np.append(0, maps[:-1, 0])
        known = place < width
        each = np.where(known, count[np.arange(len(at)), np.minimum(place, width - 1)], 0)
        for k in np.unique(piece[~known]).tolist():  # from the first unknown state on, chunk by chunk
            c = first[k] + int(np.argmax(~known[first[k] : last[k] + 1]))
            now = end[c - 1, place[c - 1]]
            for c in range(c, last[k] + 1):
                found = np.flatnonzero(domain[c] == now)
                if len(found):
                    now, each[c] = end[c, found[0]], count[c, found[0]]
                else:
                    after, n = self._run(raw, at[c : c + 1], size[c : c + 1], np.array([now], dtype=np.int32))
                    now, each[c] = after[0], n[0]
        return np.bincount(piece, weights=each, minlength=len(begins)).astype(np.int64)


@functools.cache
def counter(path: str) -> Counter:
    """One transducer for each Python process."""
    return Counter(vocabs.load(path))


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """The number of tokens of each text."""
    compiled = counter(path)
    specials = compiled.vocab.specials
    found = np.zeros(len(texts), dtype=np.int64)
    owner = None
    if any(s in t for t in texts for s in specials):
        segments, after = vocabs.split_special(texts, specials)
        owner = np.array([k for k, _ in after])
        np.add.at(found, [k for k, special in after if special >= 0], 1)
    else:
        segments = texts
    cut = pieces(segments)
    each = compiled.counts(cut.data, cut.starts, cut.ends)
    belongs = cut.text if owner is None else owner[cut.text]
    return found + np.bincount(belongs, weights=each, minlength=len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, UTF-8 bytes, tokens, and whether they exceed ``limit``."""

    @frees
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_steps(batches):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array(count_texts(texts, tokenizer))],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    counted = text_column(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under the 50k byte-level vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
