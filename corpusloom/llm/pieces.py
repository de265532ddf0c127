"""Splitting oversized texts along their structure tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import distinct_rows
from ..runtime import Scratch, spread

WORD = re.compile(r"\S+")
FENCE = re.compile(r"^\s*(```|~~~)")
HASH = re.compile(r"^\s{0,3}(#{1,6})\s*\S")
WIKI = re.compile(r"^\s*(={2,6})\s*\S.*?\1\s*$")
HTML = re.compile(r"^\s*<h([1-6])\b", re.I)
LATEX = re.compile(r"^\s*\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{")
BOLD = re.compile(r"^\s*\*\*[^*]{1,80}\*\*(\s*\*\*[^*]{1,80}\*\*)?\s*$")
RULE = re.compile(r"^\s*(={3,}|-{3,})\s*$")
ITEM = re.compile(r"^\s*([-+*•–]|\d{1,3}[.)]|<li\b|\\item\b)\s*\S", re.I)
SENTENCE = re.compile(r"[.!?。！？…][\"'”’)\]]*$")
LATEX_LEVEL = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}

#: Depths at which the tree branches, from sections (1 to 6) down to words.
PARAGRAPH, LINE, SENTENCE_DEPTH, CLAUSE, WORD_DEPTH = 7, 8, 9, 10, 11


def _heading(line: str, following: str) -> int:
    """Level of the heading a line is, 0 for none."""
    if m := HASH.match(line) or WIKI.match(line):
        return len(m.group(1))
    if m := HTML.match(line):
        return int(m.group(1))
    if m := LATEX.match(line):
        return LATEX_LEVEL[m.group(1)]
    if BOLD.match(line):
        return 2
    if line.strip() and len(line) < 120 and (m := RULE.match(following)):
        return 1 if "=" in m.group(1) else 2
    return 0


def branch_depths(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """(character spans of all words, depth of the tree at which each word starts a new branch).

    Headings open sections; below are paragraphs, lines (list items, table rows, code), sentences,
    clauses and words. Inside a code block only lines branch, and a heading stays with what follows.
    """
    words: list[tuple[int, int]] = []
    depth: list[int] = []
    at = 0
    lines = text.split("\n")
    code = blank = after_heading = False
    for k, line in enumerate(lines):
        found = [(m.start() + at, m.end() + at) for m in WORD.finditer(line)]
        at += len(line) + 1
        if not found:
            blank = True
            continue
        fence = bool(FENCE.match(line))
        level = 0 if code or fence else _heading(line, lines[k + 1] if k + 1 < len(lines) else "")
        if level:
            start = level
        elif code or after_heading:
            start = LINE if code else SENTENCE_DEPTH
        elif blank or (fence and not code):
            start = PARAGRAPH
        elif ITEM.match(line) or fence or line.lstrip().startswith(("|", "{|", ">")):
            start = LINE
        else:
            # A line that only wraps goes on with its sentence.
            ended = not words or SENTENCE.search(text[words[-1][0] : words[-1][1]])
            start = LINE if ended else SENTENCE_DEPTH + 1
        for i, (a, b) in enumerate(found):
            if i == 0:
                depth.append(start)
            elif code or fence:
                depth.append(WORD_DEPTH)
            else:
                last = text[words[-1][0] : words[-1][1]]
                depth.append(SENTENCE_DEPTH if SENTENCE.search(last) else CLAUSE if last[-1] in ",;:" else WORD_DEPTH)
            words.append((a, b))
        after_heading = bool(level)
        blank = False
        if fence:
            code = not code
    return words, depth


def pack(depth: list[int], limit: int) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` words, cut at the shallowest branches that allow it.

    A subtree within the limit stays whole, and neighbouring whole siblings are merged as long as
    they fit; only an oversized node is split into its children. What comes of it isn't merged
    with its siblings, so no span runs over the border of a node that was split.
    """

    def split(a: int, b: int) -> list[tuple[int, int]]:
        if b - a <= limit:
            return [(a, b)]
        top = min(depth[a + 1 : b])
        if top >= WORD_DEPTH:
            return [(x, min(x + limit, b)) for x in range(a, b, limit)]
        cuts = [a, *(i for i in range(a + 1, b) if depth[i] == top)]
        out: list[tuple[int, int]] = []
        open_ = False  # whether the last span is of whole siblings
        for x, y in zip(cuts, [*cuts[1:], b]):
            if y - x > limit:
                out += split(x, y)
                open_ = False
            elif open_ and y - out[-1][0] <= limit:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
                open_ = True
        return out

    return split(0, len(depth)) if depth else []


def split_text(text: str, limit: int = 450, overlap: int = 64) -> list[tuple[str, int, int]]:
    """(piece, its words, words it shares with the piece before) in order.

    Every piece but the first begins with the last ``overlap`` words of the one before; no piece
    has more than ``limit`` words; without the overlaps the pieces make up the text. Words are
    separated by white space. A text within the limit is one piece, a blank one none. Where the
    first piece would have fewer words than the overlap, it is merged with the second, whatever
    border lies between, as nothing else could be overlapped.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    words, depth = branch_depths(text)
    if len(words) <= limit:
        return [(text, len(words), 0)] if words else []
    cores = pack(depth, limit - overlap)
    while len(cores) > 1 and cores[0][1] < overlap:  # too short to be overlapped; the first may reach the limit
        cores[:2] = [(0, cores[1][1])]
    out = []
    for k, (a, b) in enumerate(cores):
        begin = a - overlap if k else 0
        out.append((text[words[begin][0] : words[b - 1][1]], b - begin, a - begin))
    return out


def split_oversized(
    df: DataFrame, scratch: Scratch, key: str = "chunk_id", section: str = "section", text: str = "text", limit: int = 450, overlap: int = 64
) -> DataFrame:
    """(key, section, piece_no, n_pieces, n_words, overlap_words, piece) of texts above the limit.

    Pieces are numbered from 1. Texts of at most ``limit`` words, null and blank ones give no
    rows; rows alike in key, section and text count once; null keys and sections are kept. Other
    columns are not read, so extra or clashing names don't matter. An empty table gives no rows.
    """
    kinds = [df.schema[c].dataType.simpleString() for c in (key, section)]
    schema = f"`{key}` {kinds[0]}, `{section}` {kinds[1]}, piece_no int, n_pieces int, n_words int, overlap_words int, piece string"
    # n + 1 words need 2n + 1 characters at least, so short texts never reach Python.
    long = spread(distinct_rows(df.select(key, section, text).where(F.length(text) > 2 * limit), scratch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, value in enumerate(b.column(2)):
                found = split_text(value.as_py(), limit, overlap)
                if len(found) > 1:
                    at += [i] * len(found)
                    rows += [(k + 1, len(found), n, shared, piece) for k, (piece, n, shared) in enumerate(found)]
            if rows:
                no, of, n, shared, piece = zip(*rows)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), *(pa.array(x, pa.int32()) for x in (no, of, n, shared)), pa.array(piece)],
                    names=[key, section, "piece_no", "n_pieces", "n_words", "overlap_words", "piece"],
                )

    return long.mapInArrow(run, schema)
