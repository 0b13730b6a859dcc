"""Text as column expressions: normalising, tokens, terms, keywords, markers.

The engine knows three tokenizers, which differ on purpose: index terms fold accents, feature terms treat accented
letters as separators, question keywords keep case. Patterns are spelled out, so that no engine's idea of \\w matters.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chinese characters that count as words by themselves (a fixed value, as a regular-expression range).
CJK = r"\x{3400}-\x{9fff}"



def _folding() -> tuple[str, str]:
    """Lower-case letters that are a plain letter with one mark, and those plain letters; then the marks, which go."""
    letters = {}
    for c in map(chr, range(0xC0, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) == 2 and unicodedata.category(parts[1]) == "Mn":
            letters[c] = parts[0]
    return "".join(letters) + "".join(map(chr, range(0x300, 0x370))), "".join(letters.values())


#: What index terms fold: letters with accents to plain ones; combining marks have no counterpart and vanish.
ACCENTED, PLAIN = _folding()


def collapse(text: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Without white space, line ends included, at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """Lower case, with the one letter whose full case folding is longer."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalize(text: Column) -> Column:
    """The key under which names, aliases and tags are equal."""
    return fold(collapse(text))


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def count_words(text: Column) -> Column:
    """Words of ASCII letters, digits and underscores, and Chinese characters."""
    return F.regexp_count(text, F.lit(rf"[A-Za-z0-9_]+|[{CJK}]"))


def count_others(text: Column) -> Column:
    """Characters outside such words."""
    return F.length(F.regexp_replace(text, rf"[A-Za-z0-9_{CJK}]", ""))


def estimate_tokens(text: Column) -> Column:
    """Words of ASCII letters, digits and underscores, each Chinese character, and one for eight other characters."""
    words = F.regexp_extract_all(text, F.lit(rf"([A-Za-z0-9_]+|[{CJK}])"), 1)
    covered = F.length(F.array_join(words, ""))
    allowance = F.floor(F.greatest(F.length(text) - covered, F.lit(0)) / 8)
    return F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.size(words) + allowance)
    ).cast("long")


def index_terms(text: Column) -> Column:
    """Terms of the inverted index, in order: runs of letters and digits, lower-cased, accents folded."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(r"([\p{L}\p{N}]+)"), 1)


def first_index_term(text: Column) -> Column:
    """The first of a text's terms; '' where there is none."""
    return F.regexp_extract(F.translate(F.lower(text), ACCENTED, PLAIN), r"([\p{L}\p{N}]+)", 1)


def query_phrases(text: Column) -> Column:
    """The phrases that a question asks the index for; a phrase may hold several index terms."""
    return F.regexp_extract_all(text, F.lit(rf"([A-Za-z0-9_+-]+|[{CJK}]+)"), 1)


def pairs(items: Column, joiner: str) -> Column:
    """Neighbours joined; empty for fewer than two."""
    return F.when(
        F.size(items) > 1,
        F.zip_with(
            F.slice(items, F.lit(1), F.size(items) - 1),
            F.slice(items, F.lit(2), F.size(items) - 1),
            lambda a, b: F.concat(a, F.lit(joiner), b),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _cjk_runs(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(rf"([{CJK}]+)"), 1)


def _characters(runs: Column) -> Column:
    return F.filter(F.flatten(F.transform(runs, lambda r: F.split(r, ""))), lambda c: c != "")


def _character_pairs(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: pairs(F.filter(F.split(r, ""), lambda c: c != ""), "")))


def features(text: Column) -> Column:
    """What feature hashing counts: words, word pairs, Chinese characters and their pairs."""
    folded = fold(text)
    words = F.regexp_extract_all(folded, F.lit("([a-z0-9_]+)"), 1)
    runs = _cjk_runs(folded)
    return F.concat(words, pairs(words, "::"), _characters(runs), _character_pairs(runs))


def rerank_terms(text: Column, extra: str = "") -> Column:
    """The set of terms that lexical overlap compares. extra: further characters of a word."""
    folded = fold(text)
    words = F.regexp_extract_all(folded, F.lit(f"([a-z0-9_{extra}]+)"), 1)
    runs = _cjk_runs(folded)
    return F.array_distinct(F.concat(words, _characters(runs), _character_pairs(runs)))


def keywords(text: Column, most: int = 16) -> Column:
    """The first distinct keywords of a question."""
    found = F.regexp_extract_all(text, F.lit(rf"([A-Za-z0-9_-]{{2,}}|[{CJK}]{{2,8}})"), 1)
    return F.slice(F.array_distinct(found), 1, most)


def subjects(text: Column, last: int = 6, inside: bool = False) -> Column:
    """Acronyms and hyphenated capitals, distinct in order of appearance, the last of them; inside: acronyms that end a word, too (7CE1)."""
    begins = "" if inside else r"\b"
    named = F.array_distinct(
        F.regexp_extract_all(text, F.lit(rf"(\b(?:[A-Z][A-Z0-9]*)(?:-[A-Z0-9]+)+\b|{begins}[A-Z]{{2,}}[0-9]*\b)"), 1)
    )
    return F.slice(named, F.greatest(F.size(named) - last + 1, F.lit(1)), F.lit(last))


def citation_markers(text: Column) -> Column:
    """Distinct evidence ids in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(S[0-9]+)\]"), 1))


#: A follow-up, and words that name a task (fixed values).
FOLLOW_UP = r"(?i)^(?:那|那么|所以|还有|然后)|(?:它|这个|那个|该|其|这些|上述|前面|刚才)|\b(?:it|that|those|they|this)\b"
TASK_WORDS = {
    "compare": r"比较|区别|异同|对比|(?i)compare",
    "synthesis": r"综合|总结|概述|概览|摘要|归纳|(?i)synthesize|(?i)summarize|(?i)summary|(?i)overview",
    "explanation": r"为什么|如何|怎么|(?i)why|(?i)how",
}

#: Texts that try to give orders (fixed values).
INSTRUCTIONS = (
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?",
    r"(?i)(?:system|developer)\s*(?:prompt|message)\s*:",
    r"(?:忽略|无视).{0,12}(?:指令|要求|提示词)",
    r"(?:系统|开发者)(?:提示词|消息|指令)\s*[：:]",
    r"(?:执行|运行).{0,16}(?:命令|脚本|代码)",
)


def is_follow_up(text: Column) -> Column:
    return text.rlike(FOLLOW_UP)


def task_type(text: Column) -> Column:
    kind = F.lit("factual")
    for name, words in reversed(TASK_WORDS.items()):
        kind = F.when(text.rlike(words), F.lit(name)).otherwise(kind)
    return kind


def gives_orders(text: Column) -> Column:
    found = F.lit(False)
    for pattern in INSTRUCTIONS:
        found = found | text.rlike(pattern)
    return found


def rewrite_question(question: Column, follow_up: Column, context: Column, previous: Column) -> Column:
    """A follow-up gains the context's subjects, or else the user's previous words."""
    named = subjects(context)
    compact = F.substring(collapse(previous), 1, 500)
    return (
        F.when(~follow_up | (F.coalesce(context, F.lit("")) == ""), question)
        .when(F.size(named) > 0, collapse(F.concat_ws(" ", F.array_join(named, " "), question)))
        .when(F.coalesce(compact, F.lit("")) != "", F.concat(compact, F.lit("；"), question))
        .otherwise(question)
    )


def repeats_phrase(text: Column, longest: int = 16) -> Column:
    """A phrase of 2 or more characters three times in a row."""
    return text.rlike(rf"(.{{2,{longest}}}?)\1\1")


def bare(text: Column) -> Column:
    """Letters and digits only, folded: the key of equal utterances."""
    return fold(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", ""))


def safe_stem(name: Column, most: int = 80) -> Column:
    """A name that any file system takes."""
    cleaned = F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}_.-]+", "-"), F.lit("-._ "))
    return F.coalesce(blank_to_null(F.substring(cleaned, 1, most)), F.lit("item"))


#: A tag in its canonical form (a fixed value).
CANONICAL_TAG = rf"^[a-z0-9{CJK}]+(?:-[a-z0-9{CJK}]+)*$"


def suggested_tag(tag: Column) -> Column:
    return F.trim(F.regexp_replace(fold(F.trim(tag)), rf"[^a-z0-9{CJK}]+", "-"), F.lit("-"))


def join_tokens(left: Column, right: Column) -> Column:
    """Two spoken tokens: no space before punctuation, one between words of ASCII letters and digits."""
    spaced = left.rlike(r"[A-Za-z0-9]$") & right.rlike(r"^[A-Za-z0-9]")
    return F.when(spaced, F.concat(left, F.lit(" "), right)).otherwise(F.concat(left, right))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def excerpt(text: Column, most: int = 360) -> Column:
    cut = F.rtrim(F.substring(text, 1, most))
    return F.when(F.length(text) > most, F.concat(cut, F.lit("…"))).otherwise(cut)


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]<>|])", r"\\$1")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?%?)"), 1)


#: A number with its unit (fixed value).
MEASURE = r"(?i)\d+(?:\.\d+)?\s*(?:%|％|倍|万|亿|GB|MB|ms|秒|分钟|小时|条|页)"


def measures(text: Column) -> Column:
    """Numbers with their units, as they are written."""
    return F.regexp_extract_all(text, F.lit(MEASURE), F.lit(0))


def bounded(text: Column, most: int) -> Column:
    """empty, too_long or ok: what a question or title is, without the white space around it."""
    inner = strip(F.coalesce(text, F.lit("")))
    return F.when(inner == "", "empty").when(F.length(inner) > most, "too_long").otherwise("ok")


def safe_url(url: Column) -> Column:
    """An http or https address that may stand in a link, else null."""
    return F.when(strip(url).rlike(r"(?i)^https?://[^\s<>\"']+$"), strip(url))


def diagram_label(text: Column, most: int = 80) -> Column:
    """A label of a diagram's node: one line, without quotes and brackets."""
    plain = collapse(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\"\[\]{}|<>`]", " "))
    return F.substring(plain, 1, most)


def acronyms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Z0-9]{1,})\b"), 1)
