"""Text operators as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as white space.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_CHAR = r"\p{L}\p{N}_"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def words(text: Column) -> Column:
    """White-space separated words; an empty array for null and blank."""
    return F.coalesce(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != ""), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of white-space separated words, 0 for null.

    The pieces of a split less the empty ones it leaves at either end, which is half the work of
    filtering them out.
    """
    pieces = F.size(F.split(text, f"[{SPACE}]+"))
    ends = F.substring(text, 1, 1).rlike(f"[{SPACE}]").cast("int") + F.substring(text, -1, 1).rlike(f"[{SPACE}]").cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(pieces - ends)


def clean_text(text: Column) -> Column:
    """Image links out, at most one blank line, single spaces, stripped."""
    t = F.regexp_replace(text, r"(?d)!\[.*?\]\(.*?\)", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(t, r" {2,}", " "))


#: What is cut from a chunk before embedding, in this order, and what stands for it.
CHUNK_SCRAPS = (
    (r"(?d)!\[.*?\]\(.*?\)", ""),
    (r"(?d)\[([^\]]*)\]\(.*?\)", "$1"),
    (f"(?md)^#+[{SPACE}]*", ""),
    (r"\x{FFFD}", ""),
    (r"\|[^|\n]{0,30}\|[^|\n]{0,30}\|", ""),
    (r"\|Col[0-9]+", ""),
    (rf"(?md)^\|.*\|[{SPACE}]*$", ""),
    (r"(?md)^[-|:]+$", ""),
    (rf"\[[{WORD_CHAR}{SPACE}]*\]", ""),
    (r"_([^_]{1,3})_", ""),
)


def clean_chunk_text(text: Column) -> Column:
    """Markup scraps out before embedding; formulas stay.

    The order of the steps matters: links keep their words, table scraps and rules go, then lines
    in which letters, digits and white space aren't above half.
    """
    t = text
    for pattern, by in CHUNK_SCRAPS:
        t = F.regexp_replace(t, pattern, by)
    t = F.array_join(F.filter(F.split(t, "\n"), readable_line), "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(t, r" {2,}", " "))


def readable_line(line: Column) -> Column:
    kept = F.length(F.regexp_replace(line, rf"[^\p{{L}}\p{{N}}{SPACE}]", ""))
    return (F.length(line) == 0) | (kept * 2 > F.length(line))


#: Forms of the headings after which only references follow.
REFERENCE_HEADINGS = (
    rf"\*\*[0-9]*\.?\*\*[{SPACE}]*\*\*[Rr]eferences\*\*",
    rf"#+[{SPACE}]*(?:[0-9]+\.?[{SPACE}]+)?[Rr]eferences",
    r"\*\*[Rr]eferences\*\*",
    rf"[Rr]eferences[{SPACE}]*$",
    rf"\*\*[0-9]*\.?\*\*[{SPACE}]*\*\*[Bb]ibliography\*\*",
    rf"#+[{SPACE}]*(?:[0-9]+\.?[{SPACE}]+)?[Bb]ibliography",
    rf"\*\*[Aa]cknowledg[{WORD_CHAR}]*\*\*",
)


def strip_references(text: Column) -> Column:
    """The text before the first reference heading, stripped; unchanged where there is none."""
    at = F.regexp_instr(text, F.lit("(?md)^(?:" + "|".join(REFERENCE_HEADINGS) + ")"))
    return F.when(at > 0, strip(F.substring(text, F.lit(1), at - 1))).otherwise(text)


#: What is counted to tell a list of references.
CITATION_MARKS = {
    "doi": r"https?://doi\.org|doi\.org|arxiv\.org",
    "year": r"\b(?:19|20)[0-9]{2}\b",
    "author_year": rf"[A-Z][a-z]+[.,][{SPACE}]*(?:19|20)[0-9]{{2}}",
    "conf": rf"In[{SPACE}]+_|In[{SPACE}]+Proc|In[{SPACE}]+\*",
    "page": rf"(?i)\bpp\.[{SPACE}]*[0-9]|pages?[{SPACE}]*[0-9]",
}


def citation_features(text: Column) -> dict[str, Column]:
    """Counts of what makes a text look like a list of references."""
    found = {name: F.regexp_count(text, F.lit(p)) for name, p in CITATION_MARKS.items()}
    return found | {"n_words": word_count(text)}


def citation_score(f: dict[str, Column]) -> Column:
    return f["doi"] * 3 + f["author_year"] * 2 + f["conf"] * 2 + f["page"] * 2 + f["year"]


def is_citation(text: Column) -> Column:
    f = citation_features(text)
    score = citation_score(f)
    return (
        (f["n_words"] == 0) | (f["doi"] >= 2) | (f["conf"] >= 2) | ((score > 8) & (f["n_words"] < 300)) | (score > 15)
    )


def is_quality(text: Column, min_words: int = 30, min_alpha: float = 0.6) -> Column:
    """Enough words, enough of them with a letter, and no list of references."""
    n = word_count(text)
    alpha = F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w.rlike(r"\p{L}")))
    return (n >= min_words) & (alpha >= min_alpha * n) & ~is_citation(text)


def lexical_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and hyphens with more than one character."""
    t = F.regexp_replace(F.lower(text), f"[^a-z0-9{SPACE}-]", " ")
    return F.filter(F.split(t, f"[{SPACE}]+"), lambda w: F.length(w) > 1)


def strip_thinking(text: Column) -> Column:
    """A model's answer without its closed and then its unclosed thinking."""
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(t, r"(?s)<think>.*", ""))


def json_between_braces(text: Column) -> Column:
    """From the first opening to the last closing brace; null where there are none."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), F.substring(text, first, last - first + 1))


def percent(share: Column, digits: int = 2) -> Column:
    """A share as text in percent, such as ``81.67%``; null for null."""
    return F.format_string(f"%.{digits}f%%", F.round(share.cast("double") * 100, digits))


def score_distance(score: Column) -> Column:
    """1 - sigmoid."""
    return F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


#: Substrings of a lower-case title and the topic they stand for, first hit wins.
TOPICS = (
    ("rag", "retrieval-augmented generation"),
    ("lora", "parameter-efficient fine-tuning"),
    ("qlora", "quantised fine-tuning"),
    ("hallucin", "LLM hallucination"),
    ("prompt", "prompt engineering"),
    ("instruct", "instruction tuning"),
)
DEFAULT_TOPIC = "machine learning"


def topic_of(title: Column) -> Column:
    low = F.lower(title)
    out = F.when(F.contains(low, F.lit(TOPICS[0][0])), F.lit(TOPICS[0][1]))
    for part, topic in TOPICS[1:]:
        out = out.when(F.contains(low, F.lit(part)), F.lit(topic))
    return out.otherwise(F.lit(DEFAULT_TOPIC))
