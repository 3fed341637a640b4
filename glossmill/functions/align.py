"""Levenshtein alignment with a fixed tie-break, as Arrow batches.

An alignment is a string over E (equal), S, D and I in reading order.  Of equally cheap ways into a
cell the diagonal is taken, else the deletion, else the insertion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import arrow_function

EQUAL, SUB, DELETE, INSERT = "ESDI"


def op_string(ref: Sequence[str], hyp: Sequence[str]) -> str:
    """The alignment of two token sequences; one byte a cell is kept for the way back.

    A common end is equal in every cheapest alignment that prefers the diagonal, so it is left out of the table.
    """
    n, m = len(ref), len(hyp)
    tail = 0
    while tail < n and tail < m and ref[n - 1 - tail] == hyp[m - 1 - tail]:
        tail += 1
    n, m = n - tail, m - tail
    above = list(range(m + 1))
    ways = []
    for i in range(n):
        x, diagonal, left = ref[i], i, i + 1
        row, way = [left], bytearray(m)
        for j in range(m):
            up = above[j + 1]
            best = diagonal if x == hyp[j] else diagonal + 1
            if best > up + 1 or best > left + 1:
                best, way[j] = (up + 1, 1) if up <= left else (left + 1, 2)
            diagonal, left = up, best
            row.append(best)
        above = row
        ways.append(way)
    out = []
    i, j = n, m
    while i and j:
        step = ways[i - 1][j - 1]
        if step == 0:
            i, j = i - 1, j - 1
            out.append(EQUAL if ref[i] == hyp[j] else SUB)
        elif step == 1:
            i -= 1
            out.append(DELETE)
        else:
            j -= 1
            out.append(INSERT)
    out.append(DELETE * i + INSERT * j)
    return "".join(reversed(out)) + EQUAL * tail


def _align_ops(ref: list, hyp: list) -> list[str]:
    """Alignments of two columns of tokens."""
    return [op_string(r or [], h or []) for r, h in zip(ref, hyp)]


_LANGS = ("zh", "en", "num", "other")
_COUNTERS = ["hits", "subs", "dels", "ins", *[f"{k}_{x}" for k in ("sub", "del", "ins") for x in _LANGS], "poi_err", "en_sub_by_zh", "en_lost"]


def points_of_interest(langs: Sequence[str], window: int) -> set[int]:
    """Places within ``window`` of a switch, as ``text.poi_indices`` has them.

    The kernels find these themselves: an expression with nested lambdas cannot be an argument of theirs.
    """
    out: set[int] = set()
    before = None
    for i, x in enumerate(langs):
        if x in ("zh", "en"):
            if before is not None and x != before:
                out.update(range(max(0, i - window), min(len(langs), i + window)))
            before = x
    return out


def _score_ops(ref: list, ref_langs: list, hyp: list, hyp_langs: list, window: list) -> list[dict]:
    """The alignment and the counters that follow from it.

    Substitutions and deletions belong to the reference token's language, insertions to the hypothesis
    token's.  An insertion is at a point of interest if the token on either side of it is one.
    """
    rows = []
    for r, rl, h, hl, w in zip(ref, ref_langs, hyp, hyp_langs, window):
        ops, points = op_string(r, h), points_of_interest(rl, w)
        row = dict.fromkeys([f"{k}_{x}" for k in ("sub", "del", "ins") for x in _LANGS] + ["poi_err", "en_sub_by_zh", "en_lost"], 0)
        i = j = 0
        for op in ops:
            if op == EQUAL:
                i, j = i + 1, j + 1
            elif op == INSERT:
                row[f"ins_{hl[j]}"] += 1
                row["poi_err"] += i in points or i - 1 in points
                j += 1
            else:
                row[f"{'sub' if op == SUB else 'del'}_{rl[i]}"] += 1
                row["poi_err"] += i in points
                if rl[i] == "en":
                    row["en_lost"] += 1
                    row["en_sub_by_zh"] += op == SUB and hl[j] == "zh"
                i, j = i + 1, j + (op == SUB)
        rows.append({"ops": ops, "hits": ops.count(EQUAL), "subs": ops.count(SUB), "dels": ops.count(DELETE), "ins": ops.count(INSERT), **row})
    return rows


def _joined(toks: list[str], langs: list[str]) -> str:
    return "".join(t if not k or langs[k] == langs[k - 1] == "zh" else " " + t for k, t in enumerate(toks))


def _span_lang(langs: list[str]) -> str | None:
    return None if not langs else langs[0] if len(set(langs)) == 1 else "mixed"


_SPAN = T.StructType([T.StructField("span", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("kind", "ref_lang", "hyp_lang", "ref", "hyp")], T.StructField("is_poi", T.BooleanType()), T.StructField("lost", T.ArrayType(T.StringType()))])


def _edit_spans(ref: list, ref_langs: list, hyp: list, hyp_langs: list, window: list, ops: list | None = None) -> list[list[dict]]:
    """Maximal runs of edits: what was said and what came out, and whether a point of interest is touched.

    A run that begins with an insertion counts as touching the place of the insertion.  Without ``ops`` the tokens are
    aligned here: in a function of its own the alignment would take a second Python worker for each task.
    """
    out = []
    for r, rl, h, hl, w, o in zip(ref, ref_langs, hyp, hyp_langs, window, ops or [None] * len(ref)):
        points, spans = points_of_interest(rl, w), []
        o = op_string(r, h) if o is None else o
        i = j = 0
        run = None
        for op in o + EQUAL:
            if op == EQUAL:
                if run:
                    (a, b), (c, d), places = run[0], run[1], run[2]
                    said, came = r[a:b], h[c:d]
                    kind = "sub" if said and came else "del" if said else "ins"
                    lost = [t for t, x in zip(said, rl[a:b]) if x == "en"]
                    spans.append({"span": len(spans), "kind": kind, "ref_lang": _span_lang(rl[a:b]), "hyp_lang": _span_lang(hl[c:d]), "ref": _joined(said, rl[a:b]), "hyp": _joined(came, hl[c:d]), "is_poi": bool(points & places), "lost": lost})
                run = None
                i, j = i + 1, j + 1
                continue
            if run is None:
                run = [(i, i), (j, j), {i} if op == INSERT else set()]
            if op != INSERT:
                run[2].add(i)
                i += 1
            if op != DELETE:
                j += 1
            run[0], run[1] = (run[0][0], i), (run[1][0], j)
        out.append(spans)
    return out


def edit_distance(ops: Column) -> Column:
    """The number of edits in an alignment."""
    return F.length(F.translate(ops, EQUAL, ""))


def token_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance of two token arrays without Python: each distinct token becomes one character.

    The codes are those of UTF-32 from 1 up, without the surrogates, so that over a million distinct tokens keep apart.
    """
    from .text import let

    def letters(words: Column, toks: Column) -> Column:
        # a dictionary, so that a token is looked up once instead of searched for
        codes = F.map_from_arrays(words, F.transform(words, lambda _, i: F.decode(F.unhex(F.lpad(F.hex(i + F.when(i < 0xD7FF, 1).otherwise(0x801)), 8, "0")), "UTF-32")))
        return let(codes, lambda m: F.array_join(F.transform(toks, lambda x: F.element_at(m, x)), ""))

    return let(F.array_distinct(F.concat(ref, hyp)), lambda w: F.levenshtein(letters(w, ref), letters(w, hyp)))


# The optimizer must neither copy these into several expressions nor move them into a sort's projection.
align_ops = arrow_function(_align_ops, T.StringType()).asNondeterministic()
score_ops = arrow_function(_score_ops, T.StructType([T.StructField("ops", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in _COUNTERS]])).asNondeterministic()
edit_spans = arrow_function(_edit_spans, T.ArrayType(_SPAN)).asNondeterministic()
