"""Whether a text breaks off: a reading of its last block."""

from __future__ import annotations

import re

#: Marks and damage that stand after a break.
MARK = re.compile(r"(?:…|\.{3,}|�+|&#?\w{0,8}|\[(?:\.\.\.|…|truncated|cut|more)\]|\((?:truncated|cut|more|continued)\))\s*$", re.I)
CLOSED = re.compile(r"[.!?。！？؟।][\"'”’»)\]}」』*_]*$")
QUOTED = re.compile(r"[\"“«「][^\"“”«»「」\n]{2,}[\"”»」]$")
SENTENCE_INSIDE = re.compile(r"[a-z0-9à-ÿа-я)\]\"%][.!?]\s+\S|[。！？]\s*\S")

#: Last lines that are whole without a full stop.
ITEM = re.compile(r"^\s*(?:[-+*•–—▪]|\d{1,3}[.)]|\[[ xX]\])\s+\S")
REFERENCE = re.compile(r"^\s*\[\d+\]\s+\S|\bpp\.\s*\d+\s*[-–]\s*\d+$|\((?:Paper|Source|see)?\s*\[\d+\]\)$|\[\d+\]$")
ADDRESS = re.compile(r"(?:https?://|www\.)\S+$|\b[\w.+-]+@[\w-]+\.\w+$|\bdoi:\S+$", re.I)
LABELLED = re.compile(r"^[^\W\d_][\w \-]{1,40}:\s+\S")
FORMULA = re.compile(r"^[^=!?]{1,40}=\s*(?!.*[^\W\d_]{5,}.*[^\W\d_]{5,})[\w\s.,+\-*/^(){}\[\]\\|]*[\w)\]}]$|\$$|\\\]$|\\end\{\w+\*?\}$")
NAME = re.compile(r"^(?:[A-Z]\.\s*){1,3}[A-Z][\w'’-]+(?:,?\s+(?:[A-Z]\.\s*)*[A-Z][\w'’-]+)*$")
CODE = re.compile(
    r"^\s*(?:def |for |while |if |elif |else:|return\b|assert |import |from \w+ import|class |print\(|with |try:|except|```|[\w.\[\]]+(?:, *[\w.\[\]]+)* *(?:[-+*/]?=) |[\w.]+\([^)]*\)$)"
)
TABLE = re.compile(r"\t|^\s*\||\|\s*$|\s\|\s")
VERSUS = re.compile(r"^\S+ vs\.? \S+$|^\w[\w-]*, then \S")
HEADING = re.compile(r"^\s*(?:#{1,6}\s|=+\s.*=+$|\d+(?:\.\d+)*\s+[A-Z])|^Q:|^A:$")
#: Words that can't end a title, list line or sentence.
OPEN_END = set(
    "a an the of to in on at by for with from and or but as than that which who whose when while whenever because unless although "
    "if into over under between without is are was were be been has have had not no our their its this these each every some any "
    "de la le les des du un une et ou en dans sur pour par avec sans que qui est sont der die das den dem des ein eine einer und oder "
    "mit ohne von zu im auf ist sind dass el los las del una y o con sin para por al es son se и в на с по для из что не".split()
)


def _line_is_whole(line: str, first: bool) -> bool:
    """Whether a last line without a closing mark may be the end of a text."""
    bare = line.strip()
    if ITEM.match(line) or REFERENCE.search(bare) or ADDRESS.search(bare) or NAME.match(bare):
        return True
    if TABLE.search(line) or CODE.match(line) or HEADING.match(bare) or VERSUS.match(bare):
        return True
    if QUOTED.search(bare):
        return True
    inside = SENTENCE_INSIDE.search(bare)
    words = bare.split()
    last = words[-1].lower().strip(",;:")
    if LABELLED.match(bare) and not inside:
        return last not in OPEN_END and bare[-1] not in ",;:"
    if FORMULA.search(bare) and not inside:
        return True
    if last in OPEN_END or bare[-1] in ",;:-–(":
        return False
    if first and "?" in bare and bare.count("?") == 1 and not inside_prose(bare):
        return True  # a question and its explanation, as a title
    if inside:
        return False
    if first and len(words) <= 3 and not re.search(r"[぀-ヿ一-鿿]", bare):
        return True
    return first and is_title(words)


def inside_prose(line: str) -> bool:
    """A sentence ends with a full stop inside the line."""
    return re.search(r"[a-z0-9)\]\"%]\.\s+\S", line) is not None


def is_title(words: list[str]) -> bool:
    """Mostly capitalised, or opened as titles are."""
    if words[0] in ("On", "When", "How", "Why", "Towards", "Toward", "What", "Is", "Are", "Does") and len(words) <= 16 and "," not in " ".join(words):
        return True
    long = [w for w in words if len(w) > 3]
    return bool(long) and sum(w[0].isupper() for w in long) >= 0.6 * len(long) and len(words) <= 20


def breaks_off(text: str | None) -> str | None:
    """How a text breaks off: ``mark`` (a mark or damage follows the break), ``open`` or None.

    Null, empty and blank texts don't break off.
    """
    if text is None:
        return None
    body = text.rstrip().rstrip("​﻿\x00").rstrip()
    if not body:
        return None
    if (m := MARK.search(body)) and m.group().strip():
        before = body[: m.start()].rstrip()
        if before and not (m.group().lstrip().startswith("&") and m.group().rstrip().endswith(";")):
            return None if CLOSED.search(before) else "mark"
    if CLOSED.search(body):
        return None
    cut = body.rfind("\n")
    line = body[cut + 1 :]
    return None if _line_is_whole(line, cut < 0) else "open"
