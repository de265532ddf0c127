"""Papers into sections by their headings, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EXCLUDED_SECTIONS
from ..functions.text import SPACE, WORD_CHAR, strip
from ..runtime import spread

_S, _W = SPACE, WORD_CHAR
#: For each section the forms of its heading by falling priority, at line starts.
HEADINGS = {
    "abstract": [
        rf"\*\*[0-9]+\.?\*\*[{_S}]*\*\*(?:[Aa]bstract)\*\*",
        rf"#+[{_S}]*(?:[0-9]+\.?[{_S}]+)?(?:[Aa]bstract)",
        r"\*\*[Aa]bstract\*\*",
        rf"Abstract[{_S}]*$",
    ],
    "introduction": [
        rf"\*\*[0-9]+\.?\*\*[{_S}]*\*\*(?:[Ii]ntroduction)\*\*",
        rf"#+[{_S}]*(?:[0-9]+\.?[{_S}]+)?(?:[Ii]ntroduction)",
    ],
    "related_work": [
        rf"\*\*[0-9]+\.?\*\*[{_S}]*\*\*(?:[Rr]elated[{_S}]*[Ww]ork|[Bb]ackground|[Pp]reliminar)[{_W}]*\*\*",
        rf"#+[{_S}]*(?:[0-9]+\.?[{_S}]+)?(?:[Rr]elated[{_S}]*[Ww]ork|[Bb]ackground)",
    ],
    "method": [
        rf"\*\*[0-9]+\.?\*\*[{_S}]*\*\*(?:[Mm]ethod|[Aa]pproach|[Mm]odel|[Ff]ramework|[Ss]ystem|[Pp]roposed)[{_W}]*\*\*",
        rf"#+[{_S}]*(?:[0-9]+\.?[{_S}]+)?(?:[Mm]ethod|[Aa]pproach|[Mm]odel|[Ff]ramework)",
    ],
    "experiments": [
        rf"\*\*[0-9]+\.?\*\*[{_S}]*\*\*(?:[Ee]xperiment|[Ee]valuation|[Rr]esult|[Ss]etup)[{_W}]*\*\*",
        rf"#+[{_S}]*(?:[0-9]+\.?[{_S}]+)?(?:[Ee]xperiment|[Ee]valuation|[Rr]esult)",
    ],
    "discussion": [
        rf"\*\*[0-9]+\.?\*\*[{_S}]*\*\*(?:[Dd]iscussion|[Aa]nalysis|[Aa]blation)[{_W}]*\*\*",
        rf"#+[{_S}]*(?:[0-9]+\.?[{_S}]+)?(?:[Dd]iscussion|[Aa]nalysis|[Aa]blation)",
    ],
    "conclusion": [
        rf"\*\*[0-9]+\.?\*\*[{_S}]*\*\*(?:[Cc]onclusion|[Ss]ummary)[{_W}]*\*\*",
        rf"#+[{_S}]*(?:[0-9]+\.?[{_S}]+)?(?:[Cc]onclusion|[Ss]ummary)",
    ],
    "references": [
        rf"\*\*[0-9]+\.?\*\*[{_S}]*\*\*(?:[Rr]eferences|[Bb]ibliography)\*\*",
        rf"#+[{_S}]*(?:[0-9]+\.?[{_S}]+)?(?:[Rr]eferences|[Bb]ibliography)",
        r"\*\*[Rr]eferences\*\*",
        rf"References[{_S}]*$",
    ],
    "acknowledgments": [
        rf"\*\*[0-9]+\.?\*\*[{_S}]*\*\*(?:[Aa]cknowledg)[{_W}]*\*\*",
        rf"#+[{_S}]*(?:[0-9]+\.?[{_S}]+)?(?:[Aa]cknowledg)",
        rf"\*\*[Aa]cknowledg[{_W}]*\*\*",
    ],
    "appendix": [
        rf"\*\*[0-9]+\.?\*\*[{_S}]*\*\*(?:[Aa]ppendix)[{_W}]*\*\*",
        rf"#+[{_S}]*(?:[0-9]+\.?[{_S}]+)?(?:[Aa]ppendix)",
    ],
}


def _marks(text: Column) -> Column:
    """array<struct<pos, name>>: where each section that occurs starts, in order of position."""
    starts = []
    for name, patterns in HEADINGS.items():
        places = F.array(*[F.regexp_instr(text, F.lit(f"(?md)^{p}")) for p in patterns])
        starts.append(F.struct(F.get(F.filter(places, lambda x: x > 0), F.lit(0)).alias("pos"), F.lit(name).alias("name")))
    return F.array_sort(F.filter(F.array(*starts), lambda s: s["pos"].isNotNull()))


def with_sections(df: DataFrame, keys: list[str], text: str = "full_text", min_chars: int = 50) -> DataFrame:
    """(keys, text, sections): array<struct<name, body>> of every row with a text, in the order of the text.

    A section starts at the first match of the first of its patterns that matches anywhere; its
    body reaches to the next start and holds the heading. Bodies of at most ``min_chars`` are
    dropped, and text before the first heading belongs to none. Without any heading, or with only
    reference-like sections left, the whole text is one section, ``full_text``.

    Each step is a projection of its own, so that no pattern is matched again for every section.
    """
    rows = spread(df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_t")))
    marked = rows.select(*keys, "_t", _marks(F.col("_t")).alias("_m"))

    def body(s: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col("_m"), i + 1)["pos"], F.length("_t") + 1)
        return F.struct(s["name"].alias("name"), strip(F.substring(F.col("_t"), s["pos"], end - s["pos"])).alias("body"))

    cut = marked.select(*keys, "_t", F.filter(F.transform("_m", body), lambda s: F.length(s["body"]) > min_chars).alias("_s"))
    content = F.exists("_s", lambda s: ~s["name"].isin(*EXCLUDED_SECTIONS))
    whole = F.array(F.struct(F.lit("full_text").alias("name"), F.col("_t").alias("body")))
    return cut.select(*keys, F.col("_t").alias(text), F.when(content, F.col("_s")).otherwise(whole).alias("sections"))


def split_sections(df: DataFrame, key: str = "arxiv_id", text: str = "full_text", min_chars: int = 50) -> DataFrame:
    """(key, pos, section, body): a row per section of :func:`with_sections`."""
    # An outer explode, as a plain one has all of the above computed again in a filter for empty arrays.
    chosen = with_sections(df, [key], text, min_chars).select(key, F.posexplode_outer("sections").alias("pos", "x"))
    return chosen.select(key, "pos", F.col("x.name").alias("section"), F.col("x.body").alias("body"))
