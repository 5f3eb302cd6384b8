"""Text expressions: tokens, token estimates, canonical forms, links, snippets, match scores.

All are Column expressions, so they stay inside Spark's own code; ``nfkc`` and ``truncate_to_tokens`` are Arrow UDFs.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that a query does without.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with", "what", "which", "who", "how", "why"]


def _pictographs() -> str:
    """The inside of a character class of Extended_Pictographic, which Java 17 does not know by name."""
    picture = regex.compile(r"\p{Extended_Pictographic}")
    points = [p for block in (range(0xA9, 0x3300), range(0x1F000, 0x20000)) for p in block if picture.match(chr(p))]
    first = [p for i, p in enumerate(points) if i == 0 or points[i - 1] != p - 1]
    last = [p for i, p in enumerate(points) if i == len(points) - 1 or points[i + 1] != p + 1]
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(first, last))


EMOJI = f"[{_pictographs()}]"
# White space in the sense of Unicode, as the inside of a character class.
SPACE = r"\t\n\x0B\f\r\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Secrets in free text.
SECRET = r"(?i)(?:sk-[A-Za-z0-9_-]{8,}|Bearer\s+[A-Za-z0-9._~-]{8,})"
# Names of keys whose values are secret.
SECRET_KEY = r"(?i)(?:api[_-]?key|authorization|password|secret|token|private[_-]?key)"
SNIPPET = 360


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def normalised(c: Column | str) -> Column:
    """Lower case, single spaces, trimmed (apply ``nfkc`` before, where texts are not known to be in that form)."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def words(c: Column) -> Column:
    """Runs of letters and digits other than Han, lower-cased, repeats included; marks and all else split."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), r"\p{IsHan}", " "), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bigrams(c: Column) -> Column:
    """Neighbouring pairs of each run of Han; a single character is itself."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{IsHan}+"), F.lit(0))
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2))))
    return F.flatten(F.transform(runs, pairs))


def terms(c: Column) -> Column:
    """Words, then bigrams, repeats included."""
    return F.concat(words(c), bigrams(c))


def query_terms(c: Column) -> Column:
    """Distinct terms of a query, without stop words."""
    return F.array_distinct(F.concat(F.array_except(words(c), F.array(*map(F.lit, STOP_WORDS))), bigrams(c)))


def searchable(c: Column) -> Column:
    """The text with its distinct words and bigrams after it, a line each: what an index with inflated counts holds."""
    return F.concat_ws("\n", c, F.array_join(F.array_distinct(words(c)), " "), F.array_join(F.array_distinct(bigrams(c)), " "))


def estimate_tokens(c: Column) -> Column:
    """Han count 1, pictographs 2, each run of letters and digits a quarter of its length (rounded up), each run of white space 1, all else 1; null is empty."""
    c = F.coalesce(c, F.lit(""))
    count = lambda pattern: F.regexp_count(c, F.lit(pattern))
    summed = lambda runs: F.aggregate(F.regexp_extract_all(c, F.lit(runs), F.lit(0)), F.lit(0), lambda n, w: n + F.ceil(F.length(w) / 4).cast("int"))
    other = lambda inside: F.length(F.regexp_replace(c, rf"[\p{{L}}\p{{N}}{SPACE}{inside}]+", ""))
    # The class of pictographs is dear: it is asked only of texts with a character that may be one (or Han).
    plain = summed(r"[\p{L}\p{N}]+") + other("")
    special = summed(rf"[\p{{L}}\p{{N}}&&[^\p{{IsHan}}]&&[^{EMOJI[1:-1]}]]+") + count(r"\p{IsHan}") + 2 * count(EMOJI) + other(rf"\p{{IsHan}}{EMOJI[1:-1]}")
    rare = c.rlike(r"[\x{A9}\x{AE}\x{203C}\x{2049}\x{2100}-\x{10FFFF}]")
    return (F.when(rare, special).otherwise(plain) + count(f"[{SPACE}]+")).cast("long")


def canonical(c: Column) -> Column:
    """Without byte order mark, with line feeds only."""
    return F.regexp_replace(F.regexp_replace(c, "^\ufeff", ""), r"\r\n?", "\n")


def slug(title: Column) -> Column:
    """Lower-case letters and digits with hyphens between, at most 120 characters; ``page`` where nothing is left."""
    made = F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(made, 1, 120), "-+$", ""), F.lit("")), F.lit("page"))


def image_refs(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))


def link_targets(markdown: Column) -> Column:
    """Distinct identifiers of wiki://id links, in brackets or bare, lower-cased, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(markdown, F.lit(r"(?i)wiki://([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"), F.lit(1)), F.lower))


def wiki_links(markdown: Column) -> Column:
    """All identifiers of wiki://id links as they are written, repeats kept."""
    return F.regexp_extract_all(markdown, F.lit(r"(?i)wiki://([0-9a-f-]{36})"), F.lit(1))


def embedding_input(header: Column, content: Column, between: str = "\n\n") -> Column:
    """What is embedded: the parts that are not empty, with ``between`` them."""
    return F.concat_ws(between, F.nullif(header, F.lit("")), F.nullif(content, F.lit("")))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)href\s*=\s*"([^"]*)\""""), F.lit(1))


def redacted(c: Column) -> Column:
    return F.regexp_replace(c, SECRET, "[REDACTED]")


def redacted_map(m: Column) -> Column:
    """Values of secret-looking keys are hidden, other values redacted."""
    hidden = lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit("[REDACTED]")).otherwise(redacted(v))
    return F.transform_values(m, hidden)


# Names of keys whose values hold whole texts, which an audit leaves out.
PRIVATE_KEY = r"(?i)^(?:prompt|promptText|prompt_text|fullPrompt|full_prompt|sourceText|source_text|rawText|raw_text|contentMarkdown|content_markdown|content)$"


def redacted_json(c: Column, audit: bool = False) -> Column:
    """JSON with the values of secret keys hidden at any depth and secrets in other texts replaced; ``audit`` also omits whole texts. What is no JSON is treated as a text."""
    key, value, private = (regex.compile(p) for p in (SECRET_KEY, SECRET, PRIVATE_KEY))

    def clean(v: object) -> object:
        if isinstance(v, list):
            return [clean(x) for x in v]
        if isinstance(v, dict):
            return {k: "[REDACTED]" if key.search(k) else "[OMITTED]" if audit and private.search(k) else clean(x) for k, x in v.items()}
        return value.sub("[REDACTED]", v) if isinstance(v, str) else v

    def one(t: str) -> str:
        try:
            return json.dumps(clean(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return value.sub("[REDACTED]", t)

    return F.arrow_udf(lambda texts: pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.string()), T.StringType())(c)


def quality(c: Column) -> Column:
    """Struct of the shares of replacement and printable characters, and whether the text passes (not blank, at most 1 %, at least 85 %)."""
    n = F.greatest(F.length(c), F.lit(1))
    lost = F.regexp_count(c, F.lit("\ufffd")) / n
    shown = (F.length(c) - F.regexp_count(c, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))) / n
    return F.struct(lost.alias("replacement_ratio"), shown.alias("printable_ratio"), ((F.trim(c) != "") & (lost <= 0.01) & (shown >= 0.85)).alias("passes"))


def error_code(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, r"^([A-Z][A-Z0-9_]{2,80}):\s", 1), F.lit(""))


def coverage(wanted: Column, have: Column) -> Column:
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(wanted, have)) / F.size(wanted))


def words_and_bigrams_once(c: Column) -> Column:
    return F.array_distinct(terms(F.coalesce(c, F.lit(""))))


def snippet(content: Column, wanted: Column, width: int = SNIPPET) -> Column:
    """Short texts whole; else a window that begins a third of its width before the first query term found."""
    places = F.filter(F.transform(wanted, lambda t: F.instr(normalised(content), t)), lambda p: p > 0)
    start = F.greatest(F.coalesce(F.get(places, 0), F.lit(1)) - 1 - width // 3, F.lit(0))
    window = F.concat(F.when(start > 0, "…").otherwise(""), F.substr(content, start + 1, F.lit(width)), F.when(start + width < F.length(content), "…").otherwise(""))
    return F.when(F.length(content) <= width, content).otherwise(window)


def context_slice(content: Column, start: Column, end: Column, around: int = 160) -> Column:
    """The range with up to ``around`` code points on either side."""
    first = F.greatest(start - around, F.lit(0))
    return F.substr(content, first + 1, F.greatest(F.least(end + around, F.length(content)) - first, F.lit(0)))


@lru_cache(maxsize=1)
def _token_pattern() -> regex.Pattern:
    emoji, space = (regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), c) for c in (EMOJI, f"[{SPACE}]"))
    return regex.compile(rf"(?P<one>\p{{Han}})|(?P<two>{emoji})|(?P<word>(?:(?!\p{{Han}}|{emoji})[\p{{L}}\p{{N}}])+)|(?P<space>{space}+)|(?P<other>.)", regex.S)


def prefix(text: str, budget: int) -> str:
    """The longest beginning of the text whose token estimate is within the budget; of a text beyond it at most four code points a token."""
    used, whole = 0, text
    text = text[: 4 * budget + 1]
    for m in _token_pattern().finditer(text):
        kind, size = m.lastgroup, m.end() - m.start()
        cost = 2 if kind == "two" else -(-size // 4) if kind == "word" else 1
        if used + cost > budget:
            fits = 4 * (budget - used) if kind == "word" else 0
            return text[: min(m.start() + fits, 4 * budget)]
        used += cost
    return whole if len(whole) <= 4 * budget or estimate(whole) <= budget else text[: 4 * budget]


def estimate(text: str) -> int:
    """``estimate_tokens`` of one text."""
    cost = {"two": lambda n: 2, "word": lambda n: -(-n // 4)}
    return sum(cost.get(m.lastgroup, lambda n: 1)(m.end() - m.start()) for m in _token_pattern().finditer(text))


@F.arrow_udf(T.StringType())
def truncate_to_tokens(texts: pa.Array, budgets: pa.Array) -> pa.Array:
    """Each text's longest beginning within its budget of estimated tokens; null stays null."""
    pairs = zip(texts.to_pylist(), budgets.to_pylist())
    return pa.array([None if t is None or b is None else prefix(t, max(b, 0)) for t, b in pairs], pa.string())
