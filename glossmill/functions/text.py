"""Script-aware tokens and what follows from them, as Column expressions.

Every function takes and returns Columns made of built-ins and higher-order functions, so they stay in
the JVM and can be pushed around by the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZH, EN, NUM, OTHER = LANGS = ("zh", "en", "num", "other")

#: Character ranges of ideographs and of Latin letters, and Unicode white space.
CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{2a700}-\x{2ebef}\x{2f800}-\x{2fa1f}"
LATIN = r"A-Za-z\x{c0}-\x{24f}"
WHITE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: What stands for white space in vocabularies (space, line break, tab, word begin).
MARKERS = "ĠĊĉ▁"
#: One ideograph, a Latin word (apostrophes and hyphens inside), a number, or any one other character.
TOKEN = rf"([{CJK}]|[{LATIN}]+(?:[\x{{27}}\x{{2019}}-][{LATIN}]+)*|\p{{Nd}}+(?:[.,]\p{{Nd}}+)*|[^{WHITE}])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once; a column named inside a lambda would be computed at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """The tokens of a text, an array of strings; null: an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(1))


def token_lang(token: Column) -> Column:
    like = lambda p: F.regexp_like(token, F.lit(p))
    return F.when(like(f"^[{CJK}]"), ZH).when(like(f"^[{LATIN}]"), EN).when(like(r"^\p{Nd}"), NUM).otherwise(OTHER)


def token_langs(toks: Column) -> Column:
    return F.transform(toks, token_lang)


def count_lang(langs: Column, lang: str) -> Column:
    return F.size(F.filter(langs, lambda x: x == lang))


def lang_counts(langs: Column) -> Column:
    """Struct of the number of tokens in each language."""
    return F.struct(*[count_lang(langs, x).alias(x) for x in LANGS])


def code_mixing_index(langs: Column) -> Column:
    """(N - max(zh, en)) / N over zh and en tokens; 0 without any.

    Spark takes a quotient for nullable, even a guarded one, and a test for null that it moves below the tokens would cut
    the text into tokens again for each of the six counts here; with a default there is nothing to test.
    """
    zh, en = count_lang(langs, ZH), count_lang(langs, EN)
    return F.coalesce(F.when(zh + en > 0, F.least(zh, en) / (zh + en)).otherwise(F.lit(0.0)), F.lit(0.0))


def switch_points(langs: Column) -> Column:
    """Places of zh/en tokens whose language differs from the zh/en token before; others are looked through."""
    placed = F.filter(F.transform(langs, lambda x, i: F.struct(x.alias("l"), i.alias("i"))), lambda x: x["l"].isin(ZH, EN))
    turns = lambda cs: F.transform(F.filter(cs, lambda x, k: (k > 0) & (x["l"] != F.get(cs, k - 1)["l"])), lambda x: x["i"])
    return let(placed, turns)


def poi_indices(points: Column, n: Column, window: int = 1) -> Column:
    """Places within ``window`` tokens on either side of a switch point, sorted."""
    if window < 1:
        raise ValueError("window must be at least 1")
    around = F.flatten(F.transform(points, lambda b: F.sequence(b - window, b + window - 1)))
    return F.array_sort(F.array_distinct(F.filter(around, lambda p: (p >= 0) & (p < n))))


def collapse_whitespace(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, f"[{WHITE}]+", " "), F.lit(" "))


def slug(text: Column) -> Column:
    """Everything but letters, digits, - and _ becomes _."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_")


def foreign_script(n_hyp: Column, n_other: Column, min_tokens: int = 5, share: float = 0.30) -> Column:
    """Whether a hypothesis is mostly in a third script."""
    return (n_hyp >= min_tokens) & (F.coalesce(F.try_divide(n_other, n_hyp), F.lit(0.0)) > share)


def length_ratio(n_hyp: Column, n_ref: Column) -> Column:
    """hyp / ref tokens; nothing against something: infinity; nothing against nothing: 1."""
    return F.when(n_ref > 0, n_hyp / n_ref).when(n_hyp > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))


#: Scripts looked for in collapsed hypotheses, by their Unicode names.
SCRIPTS = "THAI CYRILLIC DEVANAGARI ARABIC HEBREW GREEK HANGUL HIRAGANA KATAKANA BENGALI TAMIL TELUGU GUJARATI KANNADA MALAYALAM SINHALA MYANMAR KHMER LAO TIBETAN GEORGIAN ARMENIAN ETHIOPIC CHEROKEE MONGOLIAN".split()


def dominant_script(text: Column) -> Column:
    """The script with the most letters, the one seen first on a tie; null if none of ``SCRIPTS`` occurs."""
    found = []
    for name in SCRIPTS:
        letters = rf"[\p{{Is{name.capitalize()}}}&&\p{{L}}]"
        count = F.length(text) - F.length(F.regexp_replace(text, letters, ""))
        found.append(F.struct(count.alias("n"), (-F.regexp_instr(text, F.lit(letters))).alias("at"), F.lit(name).alias("script")))
    best = F.array_max(F.array(*found))
    return let(best, lambda b: F.when(b["n"] > 0, b["script"]))


def char_script(char: Column) -> Column:
    """neutral, zh, num, en or other, for one character of a vocabulary entry."""
    like = lambda p: F.regexp_like(char, F.lit(p))
    neutral = like(rf"^[{WHITE}{MARKERS}\p{{P}}\p{{S}}\p{{C}}]$")
    return F.when(neutral, "neutral").when(like(f"^[{CJK}]$"), ZH).when(like(r"^\p{Nd}$"), NUM).when(like(r"^\p{IsLatin}$"), EN).otherwise(OTHER)


def text_scripts(text: Column) -> Column:
    """The distinct scripts of a text's characters."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), char_script)))


def allowed_by(text: Column, allowed: list[str]) -> Column:
    """Whether a vocabulary entry has no script but the allowed ones (numbers and neutral characters always may)."""
    return F.size(F.array_except(text_scripts(text), F.array(*[F.lit(x) for x in [*allowed, NUM, "neutral"]]))) == 0


def speaker_of(utt_id: Column, corpus: str = "[A-Za-z]") -> Column:
    """The number before the beginning of the corpus's name (a pattern; any letter) in ids such as 12_ABC_3; null without one."""
    found = F.regexp_extract(utt_id, rf"^(\d+)_(?:{corpus})", 1)
    return F.when(found != "", found)


def percent(value: Column, digits: int = 2) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", value * 100), F.lit("n/a"))


def number(value: Column, digits: int = 3) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", value), F.lit("n/a"))
