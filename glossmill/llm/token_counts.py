"""Token counts by finite-state transducers.

Two transducers are compiled from a byte-level BPE file.

* The *splitter* is a deterministic transducer over character classes; its
  transitions are annotated with whether a pretoken begins.  Texts are laid end to end
  and cut into chunks of equal length; a chunk is a map from every entry state to an
  exit state, the maps compose through a parallel prefix scan, and with each
  chunk's entry state known all chunks emit at once.
* The *lexicon* runs over a pretoken's bytes, from its start state at each beginning that the
  scan has found.  Its transitions are annotated with emitted-token counts, which add up to the
  pretoken's tokens, and the sums of pretokens, scanned, to those of texts.  A prefix's last token is the one
  token that ends there and may follow the last token of the prefix before it, which is decided
  by merge ranks alone (and remembered).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import mix, powers, thrifty

# Classes of characters: letter, number, other, an apostrophe that opens a contraction of two
# or three characters, white space within a run, a space or other white space before a word.
LETTER, NUMBER, OTHER, SHORT, LONG, RUN, SPACE_BEFORE, WHITE_BEFORE = range(8)
# States: what the current pretoken is.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_RUN, PREFIX, ONE_LEFT, TWO_LEFT = range(8)
N_STATES = 8
#: White space as the pattern's \s has it.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pretoken begins, by state * 16 + symbol; symbols from 8 up are first in a text."""
    step = np.zeros((N_STATES, 16), np.uint8)
    begins = np.zeros((N_STATES, 16), bool)
    into = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for state in range(N_STATES):
        for symbol in range(16):
            s, c = (FRESH, symbol - 8) if symbol > 7 else (state, symbol)
            if s in (ONE_LEFT, TWO_LEFT):
                to, new = (FRESH if s == ONE_LEFT else ONE_LEFT), False
            elif c in (SHORT, LONG) and s not in (IN_OTHERS, PREFIX):
                to, new = (ONE_LEFT if c == SHORT else TWO_LEFT), True
            elif c in (RUN, SPACE_BEFORE, WHITE_BEFORE):
                to = {RUN: IN_RUN, SPACE_BEFORE: PREFIX, WHITE_BEFORE: FRESH}[c]
                new = not (c == RUN and s == IN_RUN)
            else:
                to = into[OTHER if c in (SHORT, LONG) else c]
                new = s not in (to, PREFIX)
            step[state, symbol], begins[state, symbol] = to, new
    return step.ravel(), begins.ravel()


STEP, BEGINS = _splitter()


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or RUN (any white space) of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = RUN
    return out


def symbols(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The splitter's input for texts laid end to end; ``firsts``: places of first characters."""
    kind = _classes()[codes]
    n = len(codes)
    ahead = np.zeros(n + 2, np.uint32)
    ahead[:n] = codes
    inner = np.ones(n + 2, bool)  # the character belongs to the text of the one before it
    inner[firsts] = False
    inner[n:] = False
    out = kind.copy()
    white = kind == RUN
    before = white & inner[1 : n + 1] & ~np.append(white[1:], True)
    out[before] = np.where(codes[before] == 0x20, SPACE_BEFORE, WHITE_BEFORE)
    quote = np.flatnonzero(codes == 0x27)
    if len(quote):
        a, b = np.where(inner[quote + 1], ahead[quote + 1], 0), np.where(inner[quote + 1] & inner[quote + 2], ahead[quote + 2], 0)
        out[quote[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
        pair = a.astype(np.uint64) << np.uint64(32) | b
        out[quote[np.isin(pair, np.array([ord(x) << 32 | ord(y) for x, y in ("re", "ve", "ll")], np.uint64))]] = LONG
    out[firsts] += 8
    return out


def compose_prefix(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (a row each) under composition, in log2(rows) vector steps."""
    maps, width = maps.copy(), 1
    while width < len(maps):
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width], axis=1)
        width *= 2
    return maps


def pretoken_starts(sym: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Places where pretokens begin."""
    n = len(sym)
    if n == 0:
        return np.zeros(0, np.int64)
    rows = -(-n // chunk)
    laid = np.full(rows * chunk, OTHER, np.uint8)
    laid[:n] = sym
    laid = np.ascontiguousarray(laid.reshape(rows, chunk).T)
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], rows, axis=1)
    for k in range(chunk):
        maps = STEP.take((maps << 4) | laid[k])
    exits = compose_prefix(np.ascontiguousarray(maps.T))
    state = np.zeros(rows, np.uint8)
    state[1:] = exits[:-1, FRESH]
    emitted = np.empty((chunk, rows), bool)
    for k in range(chunk):
        at = (state << 4) | laid[k]
        emitted[k] = BEGINS.take(at)
        state = STEP.take(at)
    return np.flatnonzero(emitted.T.ravel()[:n])


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Lexicon:
    """A deterministic transducer over a pretoken's bytes, whose transitions are annotated with emitted-token counts.

    A state is an Aho-Corasick state of the vocabulary together with, for each of the last prefixes that a token
    ending later can still begin after, the last token of its encoding and the number of its tokens, relative to
    the present prefix.  That is all that the next byte's transition depends on, so the states are finitely many; they are
    compiled as texts reach them, and a transition's annotation is by how many tokens the longer prefix's encoding is longer
    (or shorter: merges take tokens back).  The sum over a pretoken's transitions is its number of tokens.
    """

    START, OFFSET = 0, 1 << 15

    def __init__(self, merges: list[tuple[bytes, bytes]], most_states: int = 250_000):
        self.ids: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for left, right in merges:
            pair = (self.ids[left], self.ids[right])
            self.pairs.setdefault(pair, len(self.parts))
            self.ids.setdefault(left + right, len(self.parts))
            self.parts.append(pair)
        self.follows: dict[int, bool] = {}
        self.most_states = most_states
        self._compile()
        self._forget()

    def _forget(self) -> None:
        start = (0, (-1,), (0,))
        self.states: list[tuple[int, tuple[int, ...], tuple[int, ...]]] = [start]
        self.numbers: dict[tuple, int] = {start: 0}
        self.steps: dict[int, int] = {}

    def _compile(self) -> None:
        """Aho-Corasick over the vocabulary: by state, transitions and the tokens that end there, longest first."""
        goto: list[dict[int, int]] = [{}]
        ends: list[list[tuple[int, int]]] = [[]]
        for word, token in self.ids.items():
            at = 0
            for b in word:
                nxt = goto[at].get(b)
                if nxt is None:
                    nxt = goto[at][b] = len(goto)
                    goto.append({})
                    ends.append([])
                at = nxt
            ends[at] = [(token, len(word))]
        fail = [0] * len(goto)
        todo = deque(goto[0].values())
        while todo:
            at = todo.popleft()
            ends[at] = ends[at] + ends[fail[at]]
            for b, nxt in goto[at].items():
                back = fail[at]
                while back and b not in goto[back]:
                    back = fail[back]
                fail[nxt] = goto[back][b] if goto[back].get(b, nxt) != nxt else 0
                todo.append(nxt)
        depth = [0] * len(goto)
        todo = deque([0])
        while todo:
            at = todo.popleft()
            for nxt in goto[at].values():
                depth[nxt] = depth[at] + 1
                todo.append(nxt)
        self.goto, self.ends, self.fail, self.depth = goto, ends, fail, depth

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side.

        Walks back through the merges that made both, latest first: the two stay apart unless
        a merge over their common edge would have come before the merge that used up an edge token.
        """
        bound = 1 << 62
        while True:
            over = self.pairs.get((left, right))
            if over is not None and over < bound:
                return False
            if left > right:
                bound, inner = left, self.parts[left][1]
                if left < 256:
                    return True
                left = inner
            else:
                if right < 256:
                    if left < 256:
                        return True
                    bound, left = left, self.parts[left][1]
                    continue
                bound, right = right + 1, self.parts[right][0]

    def _may_follow(self, before: int, token: int) -> bool:
        key = before << 32 | token
        ok = self.follows.get(key)
        if ok is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            ok = self.follows[key] = self._adjacent(before, token)
        return ok

    def _transition(self, state: int, byte: int) -> int:
        """Compiles one transition: the next state's number and the annotation, in one integer."""
        at, lasts, counts = self.states[state]
        while (nxt := self.goto[at].get(byte)) is None:
            at = self.fail[at]
        token, length = next((t, n) for t, n in self.ends[nxt] if lasts[n - 1] < 0 or self._may_follow(lasts[n - 1], t))
        emitted = counts[length - 1] + 1
        far = self.depth[nxt]
        to = (nxt, (token, *lasts[:far]), (0, *(c - emitted for c in counts[:far])))
        number = self.numbers.setdefault(to, len(self.states))
        if number == len(self.states):
            self.states.append(to)
        step = self.steps[state << 8 | byte] = number << 16 | emitted + self.OFFSET
        return step

    def count(self, word: bytes) -> int:
        """The number of tokens: the sum of the annotations on the way from the start."""
        if len(self.states) > self.most_states:
            self._forget()
        steps, state, total = self.steps, self.START, 0
        for byte in word:
            step = steps.get(state << 8 | byte)
            if step is None:
                step = self._transition(state, byte)
            state, total = step >> 16, total + (step & 0xFFFF)
        return total - self.OFFSET * len(word)


class Counter:
    """Counts the tokens of whole texts; keeps the counts of pretokens seen (at most ``most``)."""

    def __init__(self, path: str, most: int = 1_500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or model.get("ignore_merges") or model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: only plain byte-level BPE can be compiled")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in their surroundings cannot be compiled")
        alphabet = byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.lexicon = Lexicon([(bytes(alphabet[c] for c in a), bytes(alphabet[c] for c in b)) for a, b in merges])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.most = most
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _pretokens(self, text: str, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Token counts of the pretokens."""
        lens = np.diff(np.append(starts, len(codes)))
        at = np.arange(len(codes)) - np.repeat(starts, lens)
        hashes = mix(np.add.reduceat(mix(codes.astype(np.uint64) + np.uint64(0x51ED27)) * powers(int(lens.max()))[at], starts) ^ lens.astype(np.uint64))
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.known, unique), max(0, len(self.known) - 1))
        found = self.known[spot] == unique if len(self.known) else np.zeros(len(unique), bool)
        counts = np.empty(len(unique), np.int32)
        counts[found] = self.counts[spot[found]]
        if not found.all():
            begin, new = starts[first[~found]].tolist(), lens[first[~found]].tolist()
            count = self.lexicon.count
            counts[~found] = [count(text[a : a + n].encode()) for a, n in zip(begin, new)]
            if len(self.known) + len(begin) > self.most:
                self.known, self.counts = unique, counts
            else:
                known = np.concatenate([self.known, unique[~found]])
                order = np.argsort(known, kind="stable")
                self.known, self.counts = known[order], np.concatenate([self.counts, counts[~found]])[order]
        return counts[back]

    def __call__(self, texts: list[str | None], most: int = 1 << 20) -> list[int]:
        """Token counts of ``texts``, worked through in blocks of about ``most`` characters."""
        out = [0] * len(texts)
        block: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if block:
                whole = "".join(block)
                codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
                edges = np.cumsum([0] + [len(b) for b in block])
                starts = pretoken_starts(symbols(codes, edges[:-1]))
                counts = self._pretokens(whole, codes, starts)
                sums = np.add.reduceat(counts, np.searchsorted(starts, edges[:-1]), dtype=np.int64)
                for owner, n in zip(owners, sums.tolist()):
                    out[owner] += n
            block.clear(), owners.clear()
            size = 0

        for i, text in enumerate(texts):
            pieces = [text or ""]
            if self.special is not None and self.special.search(text or ""):
                pieces = self.special.split(text)
                out[i] += len(pieces) - 1
            for piece in pieces:
                if piece:
                    block.append(piece), owners.append(i)
                    size += len(piece)
            if size >= most:
                flush()
        flush()
        return out


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``), one row for each row of ``docs``.

    ``path``: a byte-level BPE file in JSON, in the same place on every machine.  Counts are as its
    library gives them, without tokens added at the ends; strings of special tokens
    within texts count as one token each, as is that library's default.

    Null and empty texts have no bytes and no tokens.  Repeated rows are each counted, an
    empty table gives an empty result, other columns of ``docs`` are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count(batch.column(1).to_pylist()), pa.int64())], ["row", "n_tokens"])

    text = F.col("text").cast("string")
    sized = docs.select(F.struct("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).alias("row"), text.alias("text"))
    out = sized.mapInArrow(thrifty(rows), T.StructType([sized.schema["row"], T.StructField("n_tokens", T.LongType())]))
    return out.select("row.doc_id", "row.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
