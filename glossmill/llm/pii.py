"""Personal data by weak supervision, in DataFrame operations only.

Regex, gazetteer and context labelers vote on candidate spans.  The votes of the whole
corpus are aggregated to counts of vote patterns (a bounded table: kinds times three
votes to the number of labelers), expectation-maximisation on those counts
estimates each labeler's reliability, and its posteriors train the final span
classifier: a logistic regression on the spans themselves (length, character classes, entropy, the words around),
trained on sums of posteriors by feature values (a bounded table again), whose weights go back into the plan as an expression.

The base kinds (email, ip, card, phone) have exact patterns and always stay; the classifier
decides on the further candidates: secrets, other long numbers, and names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from .quality import let

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "name")
KINDS = BASE + ADDED

# Possessive forms of the base patterns: they match the same spans, in linear time and without recursion.
_LOCAL = "A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A maximal run of digits with single separators, of 14 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: The built-in gazetteers; :func:`find_spans` takes others.
GAZETTEERS = {
    "names": "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Anna Maria Peter Hans Klaus Petra Sabine Jean Pierre Marie Claire Sophie Carlos Juan Ana Carmen Lucia Miguel".split(),
    "titles": "Mr Mrs Ms Dr Prof Herr Frau Madame Monsieur Sr Sra".split(),
    "key_prefixes": "AKIA ghp_ gho_ xoxb- xoxp- sk- pk- AIza eyJ".split(),
    "domains": "com org net edu gov io de fr es uk eu".split(),
}
#: Words of the context labelers.
FOR_CUES = {
    "email": "e-?mail|contact|write to|mailto",
    "ip": "ip|address|host|server|from",
    "card": "card|visa|mastercard|amex|credit|iban|account",
    "phone": "phone|call|tel|fax|mobile|contact",
    "secret": "token|key|secret|password|passwd|pwd|auth|bearer|credential",
    "number": "phone|call|tel|fax|mobile|card|account|iban|ssn|social security|passport|id",
    "name": "name is|named|dear|sincerely|contact|by",
}
AGAINST_CUES = "version|vol|page|chapter|section|figure|no|isbn|year|commit|sha|md5|checksum"

def _any(terms: Sequence[str]) -> str:
    return "|".join(re.escape(t) for t in terms) or r"(?!)"


def candidate_patterns(gazetteers: Mapping[str, Sequence[str]]) -> dict[str, str]:
    return {
        "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{16,}+",
        "number": r"(?<![\p{L}0-9.+-])(?<![0-9][ -])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}+(?![ ().-]{0,2}[0-9])(?!\p{L})",
        "name": rf"(?<!\p{{L}})(?:(?:{_any(gazetteers['titles'])})\.? |(?:{_any(gazetteers['names'])})\b ?)\p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?+",
    }


#: Matches that are placed together.
CHUNK = 256
#: Kinds whose candidates are alike, and of which labelers are right or wrong alike.
FAMILY = {k: "digits" if k in ("card", "number") else k for k in KINDS}
LABELERS = ("shape", "checksum", "gazetteer", "cue", "edges", "against")


def _found(text: Column, kind: str, pattern: str, worth: Column) -> Column:
    """Array of struct(kind, s, e, word, before, after): matches with places in code points, and their surroundings."""
    shape = "array<struct<kind:string,s:int,e:int,word:string,before:string,after:string>>"
    words, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.transform(words, lambda w, i: F.struct(w.alias("word"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after")))

    def place(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["before"])
        e = s + F.length(x["word"])
        row = F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), x["word"].alias("word"), F.right(x["before"], F.lit(24)).alias("before"), F.left(x["after"], F.lit(4)).alias("after"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    # an array grows by copying, so matches are placed in chunks: linear in their number, but for a term of a chunk's size
    def chunk(acc: Column, own: Column) -> Column:
        start = F.struct(acc["at"].alias("at"), F.array().cast(shape).alias("out"))
        return F.aggregate(own, start, place, lambda done: F.struct(done["at"].alias("at"), F.concat(acc["outs"], F.array(done["out"])).alias("outs")))

    def placed(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda c: F.slice(all_, c * CHUNK + 1, F.lit(CHUNK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{shape}>").alias("outs"))
        return F.aggregate(chunks, start, chunk, lambda acc: F.flatten(acc["outs"]))

    return F.when(worth & F.regexp_like(text, F.lit(pattern)), let(parts, placed)).otherwise(F.array().cast(shape))


def digits_of(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets_fit(word: Column) -> Column:
    """Every part of a dotted number is at most 255, whatever its leading zeros."""
    return F.forall(F.split(word, "\\."), lambda p: F.regexp_like(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


#: A long run of hex digits that has both digits and letters; words joined by signs, with a short number at most.
_HEX = r"(?<![A-Za-z0-9])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{16,}+(?![A-Za-z0-9])"
_WORDY = r"^[A-Za-z]{2,}+(?:[-_/=+][A-Za-z]++)*+[-_/=+]?[0-9]{0,4}[A-Za-z]?$"


def entropy(word: Column) -> Column:
    """Bits for each character, by the word's own frequencies."""
    n = F.length(word)

    def add(acc: Column, c: Column) -> Column:
        share = (n - F.length(F.replace(word, c, F.lit("")))) / n
        return acc - share * F.log2(share)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.filter(F.split(word, ""), lambda c: c != "")), F.lit(0.0), add)).otherwise(0.0)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "y").when(no, "n").otherwise("-")


def votes(x: Column, gazetteers: Mapping[str, Sequence[str]] = GAZETTEERS) -> Column:
    """A letter for each labeler: y(es), n(o), - where it abstains, or a dot where it has nothing to say about the kind."""
    kind, word, digits = x["kind"], x["word"], digits_of(x["word"])
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    never = F.lit(False)
    no_kind = lambda *k: ~kind.isin(*k)
    share = F.length(digits) / F.length(word)
    capitals = like(word, "^(?=[A-Z]*+[0-9])[A-Z0-9]{16,}$")
    random = like(word, _HEX) | (entropy(word) >= F.when(capitals, 3.0).when(share >= 0.15, 3.5).otherwise(99.0))
    wordy = like(word, _WORDY) & ~capitals
    shape = (
        F.when(kind.isin(*BASE), F.lit("y"))
        .when(kind == "secret", _vote(random & ~wordy, wordy | like(word, "^[0-9_/=-]*[A-Za-z]{0,2}[0-9_/=-]*$")))
        .when(kind == "number", _vote(like(word, r"^(?:\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{16}|(?:[0-9]{4}[ -]){3}[0-9]{4})$"), F.length(digits) < 9))
        .otherwise(_vote(like(word, f"^(?:{_any(gazetteers['titles'])})"), never))
    )
    checksum = F.when(kind == "card", _vote(luhn(digits), ~luhn(digits))).when(kind == "ip", _vote(_octets_fit(word), ~_octets_fit(word)))
    checksum = checksum.when(kind == "phone", _vote(F.length(digits).between(10, 15), ~F.length(digits).between(10, 15))).when((kind == "number") & (F.length(digits) >= 14), _vote(luhn(digits), ~luhn(digits))).otherwise(".")
    tld = F.lower(F.regexp_extract(word, r"\.([A-Za-z]+)$", 1))
    gazetteer = (
        F.when(kind == "email", _vote(tld.isin(*gazetteers["domains"]), never))
        .when(kind.isin("card", "number"), _vote(like(digits, "^(?:4|5[1-5]|3[47]|6011)[0-9]{13,15}$"), never))
        .when(kind == "secret", _vote(like(word, f"^(?:{_any(gazetteers['key_prefixes'])})"), never))
        .when(kind == "name", _vote(like(word, f"(?:^| )(?:{_any(gazetteers['names'])})(?: |$)"), never))
        .otherwise(".")
    )
    # secrets bring their own label along: password=...
    near = F.lower(F.concat(x["before"], F.when(kind == "secret", F.regexp_extract(word, "^([A-Za-z_-]+)=", 1)).otherwise("")))
    cued = reduce(lambda a, k: a | ((kind == k) & like(near, rf"\b(?:{FOR_CUES[k]})\b")), KINDS, never)
    edges = _vote(like(x["before"], r"""(?:^|[\s"'(:=|])$""") & like(x["after"], r"""^(?:$|[\s"'),.;:!?|])"""), like(x["before"], r"[\p{L}0-9]$") & no_kind("email"))
    against = _vote(never, like(near, rf"\b(?:{AGAINST_CUES})\b[ .:=#]*$"))
    return F.concat(shape, checksum, gazetteer, _vote(cued, never), edges, against)


def estimate_reliabilities(rows: Sequence[tuple[str, str, int]], rounds: int = 50) -> tuple[dict[tuple[str, str], float], dict]:
    """Expectation-maximisation over (kind, votes, count).

    In each family of kinds a true or false span makes labeler j vote v with a probability of its own (abstaining
    is a vote too, having nothing to say is none); labelers are independent given the truth, and each kind has its own
    prior.  What is true of the base kinds' candidates is known, their checksum labeler says it, so they
    hold the truth's side fast; the others start from the majority of votes.  Returns the posterior of each (kind, votes), and the estimates.
    """
    known = {(k, v): float(v[LABELERS.index("checksum")] != "n") for k, v, _ in rows if k in BASE}
    post = {(k, v): known.get((k, v), min(0.9, max(0.1, 0.5 + 0.15 * (v.count("y") - v.count("n"))))) for k, v, _ in rows}
    says: dict = {}
    prior: dict = {}
    for _ in range(rounds):
        says = {(f, j, v, t): 0.5 for f in set(FAMILY.values()) for j in range(len(LABELERS)) for v in "yn-" for t in (0, 1)}
        prior = {k: [1.0, 1.0] for k in KINDS}
        for k, pattern, n in rows:
            for t in (0, 1):
                w = n * (post[k, pattern] if t else 1 - post[k, pattern])
                prior[k][t] += w
                for j, v in enumerate(pattern):
                    if v != ".":
                        says[FAMILY[k], j, v, t] += w
        totals = {(f, j, t): sum(says[f, j, v, t] for v in "yn-") for f in set(FAMILY.values()) for j in range(len(LABELERS)) for t in (0, 1)}
        moved = 0.0
        for k, pattern, _ in rows:
            if (k, pattern) in known:
                continue
            odds = math.log(prior[k][1] / prior[k][0])
            f = FAMILY[k]
            for j, v in enumerate(pattern):
                if v == ".":
                    continue
                # a labeler may not be held worse than chance: its yes never counts against, its no never for
                step = math.log(says[f, j, v, 1] / totals[f, j, 1]) - math.log(says[f, j, v, 0] / totals[f, j, 0])
                odds += max(0.0, step) if v == "y" else min(0.0, step) if v == "n" else step
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            moved = max(moved, abs(p - post[k, pattern]))
            post[k, pattern] = p
        if moved < 1e-6:
            break
    return post, {"prior": prior, "says": says}


#: The classifier's features and how many values each has: together they bound the table that it is trained on.
FEATURES = {"length": 6, "digits": 4, "letters": 4, "entropy": 5, "before": 16, "after": 4}


def span_features(x: Column) -> Column:
    """The span itself and its surroundings, as one digit or letter for each of :data:`FEATURES`.

    Length (by doubling), share of digits, case of the letters, entropy, the word before (hashed) and what comes after.
    """
    word, n = x["word"], F.greatest(F.length(x["word"]), F.lit(1))
    level = lambda value, *edges: F.lit(0) + sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0))
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    share = F.length(digits_of(word)) / n
    upper, lower = like(word, r"\p{Lu}"), like(word, r"\p{Ll}")
    near = F.lower(F.regexp_extract(x["before"], r"([\p{L}_]+)[^\p{L}_]*$", 1))
    after = F.when(x["after"] == "", 0).when(like(x["after"], r"^\s"), 1).when(like(x["after"], r"""^["')\]}>]"""), 2).otherwise(3)
    values = [level(n, 8, 12, 16, 24, 40), level(share, 0.25, 0.6, 1.0), F.when(upper & lower, 3).when(upper, 2).when(lower, 1).otherwise(0), level(entropy(word), 1.5, 2.5, 3.2, 4.0), F.pmod(F.xxhash64(near), F.lit(FEATURES["before"])), after]
    return F.concat(*[F.lower(F.hex(v.cast("long"))) for v in values])


def train_classifier(rows: Sequence[tuple[str, str, float, int]], rounds: int = 300, ridge: float = 1e-3) -> dict[tuple, float]:
    """Logistic regression by kind on span features, by gradient ascent on (kind, features, sum of posteriors, count).

    The posteriors of the labelers' votes are its soft labels; it never sees the votes, so what it decides by is the span.
    """
    total = sum(n for *_, n in rows) or 1
    weights: dict[tuple, float] = {}
    squares: dict[tuple, float] = {}
    cases = [([(k,), *((k, j, v) for j, v in enumerate(f))], p / total, n / total) for k, f, p, n in rows]
    for _ in range(rounds):
        slope = {f: -ridge * w for f, w in weights.items()}
        for names, positive, share in cases:
            z = sum(weights.get(f, 0.0) for f in names)
            miss = positive - share / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for f in names:
                slope[f] = slope.get(f, 0.0) + miss
        for f, g in slope.items():
            squares[f] = squares.get(f, 1e-8) + g * g
            weights[f] = weights.get(f, 0.0) + 0.5 * g / math.sqrt(squares[f])
    return weights


def _score(x: Column, weights: Mapping[tuple, float]) -> Column:
    """The classifier as an expression over kind and features: one look-up for each feature in a table of weights."""
    table = {"".join([n[0], *(f"/{part}" for part in n[1:])]): round(w, 9) for n, w in weights.items()}
    if not table:
        return F.lit(-1.0)
    held = F.create_map(*[F.lit(v) for pair in sorted(table.items()) for v in pair])
    parts = [x["kind"], *[F.concat(x["kind"], F.lit(f"/{j}/"), F.substring(x["features"], j + 1, 1)) for j in range(len(FEATURES))]]
    # a value that was not seen in training weighs nothing
    return sum((F.coalesce(F.try_element_at(held, p), F.lit(0.0)) for p in parts), F.lit(0.0))


def candidates(docs: DataFrame, gazetteers: Mapping[str, Sequence[str]] = GAZETTEERS) -> DataFrame:
    """doc_id, base and more: arrays of struct(kind, s, e, votes, features); failed: of struct(kind, votes), base candidates that are none."""
    text = F.col("text")
    has_digit, has_at = F.regexp_like(text, F.lit("[0-9]")), F.contains(text, F.lit("@"))
    worth = {"email": has_at, "name": F.lit(True)}
    raw = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    raw = raw.select(
        "doc_id",
        F.concat(*[_found(text, k, p, worth.get(k, has_digit)) for k, p in _PATTERNS.items()]).alias("base"),
        F.concat(*[_found(text, k, p, worth.get(k, has_digit)) for k, p in candidate_patterns(gazetteers).items()]).alias("more"),
    )
    voted = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), votes(x, gazetteers).alias("votes"), span_features(x).alias("features")))
    raw = raw.select("doc_id", voted(F.col("base")).alias("all"), "more")
    fits = lambda x: F.substring(x["votes"], LABELERS.index("checksum") + 1, 1) != "n"
    failed = F.transform(F.filter("all", lambda x: ~fits(x)), lambda x: F.struct(x["kind"].alias("kind"), x["votes"].alias("votes")))
    raw = raw.select("doc_id", F.filter("all", fits).alias("base"), failed.alias("failed"), "more")
    own = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    return raw.select("doc_id", "base", "failed", voted(F.when(F.size("more") > 0, own).otherwise(F.col("more"))).alias("more"))


def gazetteers_of(terms: DataFrame, most: int = 20_000) -> dict[str, list[str]]:
    """Gazetteers from a table of list (names, titles, key_prefixes or domains) and term, ``most`` terms at most; lists that it lacks are the built-in ones."""
    rows = terms.where("term <> ''").select("list", "term").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms: they become a pattern of each task's")
    unknown = {r["list"] for r in rows} - set(GAZETTEERS)
    if unknown:
        raise ValueError(f"unknown lists: {', '.join(sorted(map(str, unknown)))}")
    return {name: sorted(r.term for r in rows if r["list"] == name) or own for name, own in GAZETTEERS.items()}


def find_spans(docs: DataFrame, gazetteers: Mapping[str, Sequence[str]] = GAZETTEERS, learn: Column | None = None) -> DataFrame:
    """doc_id, base and spans, one row for each row of ``docs``; arrays of struct(s, rank, kind, e, votes, features) by start, then kind.

    ``docs``: doc_id and text; other columns are ignored.  ``learn``: which rows, by doc_id, reliabilities and classifier are
    estimated from (all).  Places are code points, ends
    exclusive.  A null or empty text has empty arrays.  Repeated rows are each
    reported (and each count in the estimates); an empty table gives an empty result.
    Without any candidate the classifier adds nothing.
    """
    found = materialize(candidates(docs, gazetteers), "pii")
    every = found.where(learn) if learn is not None else found
    plain = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["votes"].alias("votes")))
    patterns = every.select(F.explode(F.concat(plain("base"), plain("more"), "failed")).alias("x")).groupBy("x.kind", "x.votes").count()
    rows = sorted((r["kind"], r["votes"], r["count"]) for r in patterns.collect())  # at most len(KINDS) * 4 ** len(LABELERS)
    post, _ = estimate_reliabilities(rows)
    weights: dict[tuple, float] = {}
    if any(k in ADDED for k, *_ in rows):
        soft = F.create_map(*[F.lit(v) for (k, pattern), p in sorted(post.items()) if k in ADDED for v in (k + pattern, p)])
        cells = every.select(F.explode("more").alias("x")).groupBy("x.kind", "x.features").agg(F.sum(F.element_at(soft, F.concat("x.kind", "x.votes"))).alias("p"), F.count(F.lit(1)).alias("n"))
        # at most len(ADDED) times the product of FEATURES
        weights = train_classifier(sorted((r["kind"], r["features"], r["p"], r["n"]) for r in cells.collect()))
    rank = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])
    ranked = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.element_at(rank, x["kind"]).alias("rank"), x["kind"].alias("kind"), x["e"].alias("e"), x["votes"].alias("votes"), x["features"].alias("features"))))
    added = F.filter("more", lambda x: _score(x, weights) > 0)
    return found.select("doc_id", ranked(F.col("base")).alias("base"), ranked(F.concat("base", added)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(spans: str, kind: str) -> Column:
    """The number of spans of one kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
