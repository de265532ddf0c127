"""HTML, Markdown, wiki and LaTeX residue: which kinds a text has, and the text without them.

A text is scanned in layers: code blocks are taken out first, then inline code and formulas, and
what is left is read by the rules of each kind. Clean text keeps its structure in one plain
convention, whatever the kind it came in: ``#`` headings, ``-`` list items, fenced code blocks,
formulas in dollars, table rows with tabs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import distinct_rows
from ..runtime import Scratch, spread
from .boilerplate import remove_passages

KINDS = ("html", "markdown", "wiki", "latex")

#: Names of HTML elements.
ELEMENTS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del dfn div dl dt em "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li "
    "link main map mark math menu meta nav noscript object ol option p param picture pre q s samp script section select small source "
    "span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video"
).split()

_NAMES = "|".join(sorted(ELEMENTS, key=len, reverse=True))
_ATTR = r"(?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+))?)*"
TAG = re.compile(rf"</?(?:{_NAMES}){_ATTR}\s*/?>", re.I)
COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<\?xml[^>]*>", re.I | re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")

FENCE = re.compile(r"^[ \t]{0,3}(```+|~~~+)[^\n`]*\n(.*?)(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)", re.M | re.S)
PRE = re.compile(rf"(<pre{_ATTR}\s*>\s*(?:<code{_ATTR}\s*>)?)(.*?)((?:</code>\s*)?</pre>|\Z)", re.I | re.S)
BLOCK_CODE = re.compile(rf"(<code{_ATTR}\s*>)((?:(?!</code>).)*\n(?:(?!</code>).)*)(</code>)", re.I | re.S)
WIKI_CODE = re.compile(rf"<(source|syntaxhighlight|nowiki){_ATTR}\s*>(.*?)</\1>", re.I | re.S)
VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}(.*?)\\end\{\1\}", re.S)

TICKS = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+?)\1(?!`)")
DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(.*?)\\end\{\3\}", re.S)
INLINE = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s\\$])\$(?![\d$\w])|\\\((.+?)\\\)")

MARKDOWN = [
    re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+\S", re.M),
    re.compile(r"^(?=[^\n]*[^\W_])[^\n|]+\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*$", re.M),
    re.compile(r"(?<![\w*\\])\*{1,3}(?=[^\s*])[^*\n]*[^\s*\\]\*{1,3}(?![\w*])"),
    re.compile(r"(?<![\w\\])(_{1,3})(?=[^\s_])[^_\n]*[^\s_]\1(?!\w)"),
    re.compile(r"~~(?=\S)[^~\n]+~~"),
    re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:[ \t]+\"[^\"\n]*\")?\)"),
    re.compile(r"!?\[[^\[\]\n]+\]\[[^\[\]\n]+\]"),
    re.compile(r"^[ \t]{0,3}\[[^\[\]\n]+\]:[ \t]+\S", re.M),
    re.compile(r"\[\^[^\]\s]+\]"),
    re.compile(r"^[ \t]*[-+*][ \t]+(?:\[[ xX]\][ \t]+)?\S", re.M),
    re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$", re.M),
    re.compile(r"^[ \t]*\|(?![-}+|])[^\n|]+\|(?!\|)[^\n]*\|[ \t]*$", re.M),
    re.compile(r"^[ \t]{0,3}>[ \t]+\S", re.M),
]
WIKI = [
    re.compile(r"\[\[[^\[\]\n]+\]\]"),
    re.compile(r"\{\{[^{}]+\}\}|^\{\{[^{}\n]*$", re.M),
    re.compile(r"(?<!['\w`])'{2,3}(?=[^\s'])[^'\n]*(?:'[^'\n]+)*?[^\s']'{2,3}(?![\w'])"),
    re.compile(r"^(={2,6})[ \t]*[^=\s][^\n]*?\1[ \t]*$", re.M),
    re.compile(r"^[ \t]*\{\|", re.M),
    re.compile(r"^[ \t]*\|[-}][ \t]*$", re.M),
    re.compile(r"^[ \t]*!(?!\[)[^\n]*!!", re.M),
    re.compile(r"^[ \t]*\|[^\n|]+\|\|", re.M),
]
LATEX = [
    re.compile(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}"),
    re.compile(r"(?<![A-Za-z]:)(?<![\\\w.])\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{"),
    re.compile(r"\w\\(?!n\b|t\b)[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{"),
    re.compile(r"\{\\[a-zA-Z]{2,}\b"),
    re.compile(r"(?<![\w:\\.])\\(?:item|section|subsection|subsubsection|paragraph|label|ref|cite|caption|maketitle|centering|noindent|textbf|textit|emph|alpha|beta|gamma|delta|epsilon|eta|theta|lambda|mu|pi|sigma|phi|omega|sum|prod|int|frac|sqrt|cdot|times|leq|geq|neq|approx|infty|partial|nabla|ldots|dots|quad|qquad|hat|bar|tilde|vec|mathbf|mathrm|mathcal|log|exp|in|to|par|newline|bigskip|smallskip|medskip|hline|toprule|midrule|bottomrule)(?![a-zA-Z])"),
    re.compile(r"(?<!\\)\\[%&#_{}$](?!\w*\\)"),
    re.compile(r"\w~\\[a-zA-Z]+"),
]
#: Where something was taken out.
PLACE = re.compile("\x02(\\d+)\x03")
#: Without one of these no rule can apply.
ANY = re.compile(r"[<&*_`\[{\\$|~]|''|={2}|^[ \t]*[-+>#][ \t]|^[ \t]*[-=]{3}|#[ \t]", re.M)


def _take_code(text: str, kinds: set[str], kept: list[str]) -> str:
    def keep(body: str) -> str:
        kept.append("```\n" + body.strip("\n") + "\n```")
        return f"\n\x02{len(kept) - 1}\x03\n"

    def fence(m: re.Match) -> str:
        kinds.add("markdown")
        return keep(m.group(2))

    def pre(m: re.Match) -> str:
        kinds.add("html")
        return keep(html.unescape(m.group(2)))

    def wiki(m: re.Match) -> str:
        kinds.add("html" if m.group(1).lower() == "source" else "wiki")
        return keep(m.group(2))

    def verbatim(m: re.Match) -> str:
        kinds.add("latex")
        return keep(m.group(2))

    if "```" in text or "~~~" in text:
        text = FENCE.sub(fence, text)
        if "```" in text:  # a closing fence whose block began before the text
            kinds.add("markdown")
            text = re.sub(r"^[ \t]*```[^\n]*$", "", text, flags=re.M)
    if "<" in text:
        text = PRE.sub(pre, text)
        text = BLOCK_CODE.sub(pre, text)
        text = WIKI_CODE.sub(wiki, text)
    if "\\begin{" in text:
        text = VERBATIM.sub(verbatim, text)
    return text


def _formula(m: re.Match) -> str:
    return next((g for g in m.groups() if g), "").strip()


def read_markup(text: str) -> tuple[set[str], str, list[str]]:
    """(kinds, text with code and formulas taken out, what was taken out)."""
    kinds: set[str] = set()
    kept: list[str] = []
    text = text.replace("\r\n", "\n")
    if "\x02" in text or "\x03" in text:  # what marks a place is taken out like code, so no text can forge a mark

        def literal(m: re.Match) -> str:
            kept.append(m.group())
            return f"\x02{len(kept) - 1}\x03"

        text = re.sub("[\x02\x03]", literal, text)
    text = _take_code(text, kinds, kept)

    def inline(m: re.Match) -> str:
        kinds.add("markdown")
        kept.append(m.group(2))
        return f"\x02{len(kept) - 1}\x03"

    def display(m: re.Match) -> str:
        kinds.add("latex")
        kept.append("$$" + (m.group(1) or m.group(2) or m.group(4) or "").strip() + "$$")
        return f"\x02{len(kept) - 1}\x03"

    def math(m: re.Match) -> str:
        kinds.add("latex")
        kept.append("$" + (m.group(1) or m.group(2)).strip() + "$")
        return f"\x02{len(kept) - 1}\x03"

    if "`" in text:
        text = TICKS.sub(inline, text)
    if "$" in text or "\\" in text:
        text = DISPLAY.sub(display, text)
        text = INLINE.sub(math, text)
    if "<" in text and (TAG.search(text) or COMMENT.search(text)) or "&" in text and ENTITY.search(text):
        kinds.add("html")
    # Attributes and comments hold no other kind.
    bare = TAG.sub(" ", COMMENT.sub(" ", text)) if "html" in kinds else text
    for kind, rules in (("markdown", MARKDOWN), ("wiki", WIKI), ("latex", LATEX)):
        if kind not in kinds and any(r.search(bare) for r in rules):
            kinds.add(kind)
    return kinds, text, kept


def markup_kinds(text: str | None) -> list[str]:
    """The kinds of markup in a text, in the order of KINDS; what stands in code blocks isn't counted."""
    if not text or not ANY.search(text):
        return []
    found = read_markup(text)[0]
    return [k for k in KINDS if k in found]


def _html(text: str) -> str:
    text = COMMENT.sub("", text)
    text = re.sub(rf"<h([1-6]){_ATTR}\s*>", lambda m: "\n" + "#" * int(m.group(1)) + " ", text, flags=re.I)
    text = re.sub(rf"<li{_ATTR}\s*>", "\n- ", text, flags=re.I)
    text = re.sub(rf"<(?:br|hr){_ATTR}\s*/?>|</(?:h[1-6]|p|div|tr|ul|ol|table)\s*>|<(?:p|div|ul|ol|table|blockquote){_ATTR}\s*>", "\n", text, flags=re.I)
    text = re.sub(r"</t[dh]>\s*(?=<t[dh])", "\t", text, flags=re.I)
    return html.unescape(TAG.sub("", text))


#: What opens and closes inside LaTeX text, in the order in which they are tried.
LATEX_TOKEN = re.compile(r"(?<![A-Za-z]:)\\([a-zA-Z]{2,})\*?((?:\[[^\]\n]*\])*)\{|\{\\(?:it|bf|em|tt|sc|rm|sl|small|large)\b[ \t]*|\\[{}]|[{}]")
LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
#: Commands whose argument names something and is no text.
NAMING = {"cite", "citet", "citep", "ref", "eqref", "label", "pageref"}


def _commands(text: str) -> str:
    """Commands replaced by their arguments, however deep they are nested, in one pass over the text."""
    out: list[str] = []
    open_: list[tuple[int, str, str]] = []  # place of the opening in out, what stands for it, and for the closing
    at = 0
    for m in LATEX_TOKEN.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        token, name = m.group(), m.group(1)
        if token == "}":
            if open_:
                place, before, after = open_.pop()
                if before == "\x00":  # a naming command goes with all it holds
                    del out[place:]
                    if out and out[-1].endswith("~"):
                        out[-1] = out[-1][:-1]
                else:
                    out[place] = before
                    out.append(after)
                continue
        elif name in LEVELS:
            open_.append((len(out), "\n" + "#" * LEVELS[name] + " ", "\n"))
        elif name in NAMING:
            open_.append((len(out), "\x00", ""))
        elif name == "footnote":
            open_.append((len(out), " (", ")"))
        elif name in ("begin", "end"):
            open_.append((len(out), token, "}"))
        elif token[0] != "\\" and token != "{" or name:
            open_.append((len(out), "", ""))
        elif token == "{":
            open_.append((len(out), "{", "}"))
        out.append(token)
    out.append(text[at:])
    return "".join(out)


def _latex(text: str) -> str:
    text = re.sub(r"\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\])?", "", _commands(text))
    text = re.sub(r"^[ \t]*\\item\b[ \t]*", "- ", text, flags=re.M)
    text = re.sub(r"[ \t]*\\item\b[ \t]*", "\n- ", text)
    text = re.sub(r"(?<=\w)~(?=[\w\\(])", " ", text)
    return re.sub(r"\\([%&#_{}$])", r"\1", text)


def _templates(text: str) -> str:
    """Wiki templates out, however deep they are nested; a term keeps its word."""
    out: list[str] = []
    open_: list[int] = []
    at = 0
    for m in re.finditer(r"\{\{|\}\}", text):
        out.append(text[at : m.start()])
        at = m.end()
        if m.group() == "{{":
            open_.append(len(out))
            out.append("{{")
        elif open_:
            place = open_.pop()
            inside = "".join(out[place + 1 :])
            term = re.match(r"\s*term\s*\|([^|]*)", inside, re.I)
            out[place:] = [term.group(1)] if term else []
            if not term and text.startswith("\n", at):
                at += 1
        else:
            out.append("}}")
    out.append(text[at:])
    return "".join(out)


def _wiki(text: str) -> str:
    text = re.sub(r"^(={2,6})[ \t]*([^=\n].*?)\1[ \t]*$", lambda m: "#" * (len(m.group(1)) - 1) + " " + m.group(2).strip(), text, flags=re.M)
    text = re.sub(r"\[\[(?:File|Image):[^\[\]\n]*?(?:\|([^\[\]|\n]*))?\]\]", r"\1", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]", r"\1", text)
    text = _templates(text)
    text = re.sub(r"^[ \t]*\{\|[^\n]*\n?|^[ \t]*\|[-}][^\n]*\n?", "", text, flags=re.M)
    text = re.sub(r"^[ \t]*[!|](?!\[)[ \t]*([^\n]*?(?:!!|\|\|)[^\n]*)$", lambda m: re.sub(r"[ \t]*(?:!!|\|\|)[ \t]*", "\t", m.group(1)), text, flags=re.M)
    return re.sub(r"'{2,3}(?=[^\s'])([^'\n]*(?:'[^'\n]+)*?)'{2,3}", r"\1", text)


def _markdown(text: str) -> str:
    text = re.sub(r"^([^\n|#\-][^\n|]*)\n[ \t]{0,3}(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m.group(2)[0] == "=" else "## ") + m.group(1), text, flags=re.M)
    text = re.sub(r"^[ \t]*\*\*(\d+(?:\.\d+)*\.?)\*\*[ \t]+\*\*([^*\n]+)\*\*[ \t]*$", r"# \1 \2", text, flags=re.M)
    text = re.sub(r"!\[([^\[\]\n]*)\]\([^()\n]*\)", r"\1", text)
    text = re.sub(r"(?<!!)\[([^\[\]\n]*)\]\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)", r"\1", text)
    text = re.sub(r"!?\[([^\[\]\n]+)\]\[[^\[\]\n]+\]", r"\1", text)
    text = re.sub(r"^[ \t]{0,3}\[[^\[\]\n]+\]:[ \t]+\S+[^\n]*\n?", "", text, flags=re.M)
    text = re.sub(r"\[\^[^\]\s]+\]:?", "", text)
    text = re.sub(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*\\])\1(?![\w*])", r"\2", text)
    text = re.sub(r"(?<![\w\\])(_{1,3})(?=[^\s_])([^_\n]*[^\s_])\1(?!\w)", r"\2", text)
    text = re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", text)
    text = re.sub(r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?)?[ \t]*\n?", "", text, flags=re.M)
    text = re.sub(r"^[ \t]*\|(?![-}])([^\n]*)\|[ \t]*$", lambda m: "\t".join(c.strip() for c in m.group(1).split("|")), text, flags=re.M)
    text = re.sub(r"^([ \t]*)[-+*][ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", r"\1- ", text, flags=re.M)
    return re.sub(r"^[ \t]{0,3}>[ \t]+", "", text, flags=re.M)


def clean_text(text: str | None) -> tuple[str | None, list[str]]:
    """(clean text, kinds). A text without markup comes back as it is, null as null."""
    if not text or not ANY.search(text):
        return text, []
    kinds, body, kept = read_markup(text)
    if not kinds:
        return text, []
    if "html" in kinds:
        body = _html(body)
    if "latex" in kinds:
        body = _latex(body)
    if "wiki" in kinds:
        body = _wiki(body)
    if "markdown" in kinds:
        body = _markdown(body)
    for i, part in enumerate(kept):  # what was taken out later may hold what was taken out before
        kept[i] = PLACE.sub(lambda m: kept[int(m.group(1))], part)
    body = PLACE.sub(lambda m: kept[int(m.group(1))], body)
    body = re.sub(r"[ \t]+$", "", body, flags=re.M)
    body = re.sub(r"(?<=\S)  +(?=\S)", " ", re.sub(r"\n{3,}", "\n\n", body))
    return body.strip("\n"), [k for k in KINDS if k in kinds]


def strip_markup(df: DataFrame, key: str, text: str, with_text: bool = True) -> DataFrame:
    """(key, kinds) or (key, kinds, clean) of each row with a key.

    ``kinds`` is empty for a null or empty text and one without markup, whose clean text is the
    text itself. Rows alike in key and text are not merged here. Text of any length is read
    whole. Columns besides key and text are not read; an empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = (t.as_py() for t in b.column(1))
            strings = pa.list_(pa.string())
            if with_text:
                done = [clean_text(t) for t in values]
                cols = [pa.array([k for _, k in done], strings), pa.array([c for c, _ in done], pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, "kinds", "clean"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([markup_kinds(t) for t in values], strings)], names=[key, "kinds"])

    schema = f"`{key}` {kind}, kinds array<string>" + ", clean string" * with_text
    return spread(df.select(key, text).where(F.col(key).isNotNull())).mapInArrow(run, schema)


def record_kinds(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(rec_table, rec_key, kind), distinct, over tables given as (name, table, key, text)."""
    out = None
    for name, df, key, text in tables:
        found = (
            strip_markup(df, key, text, with_text=False)
            .where(F.size("kinds") > 0)
            .select(F.lit(name).alias("rec_table"), F.col(key).cast("string").alias("rec_key"), F.explode("kinds").alias("kind"))
            .distinct()
        )
        out = found if out is None else out.unionByName(found)
    return out


def clean_records(tables: list[tuple[str, DataFrame, str, str]], scratch: Scratch) -> DataFrame:
    """(rec_table, rec_key, kinds, clean) over tables given as (name, table, key, text).

    Rows alike in key and text count once. Every record with a key is here, those without markup or text too; see :func:`strip_markup`.
    The clean texts of a table are the pages of a host: passages that recur on many of them are
    removed, see :func:`boilerplate.remove_passages`, and unique runs are kept.
    """
    out = None
    for name, df, key, text in tables:
        records = distinct_rows(df.select(key, text).where(F.col(key).isNotNull()), scratch)
        pages = remove_passages(strip_markup(records, key, text), scratch, "clean")
        cleaned = pages.select(F.lit(name).alias("rec_table"), F.col(key).cast("string").alias("rec_key"), "kinds", "clean")
        out = cleaned if out is None else out.unionByName(cleaned)
    return out
