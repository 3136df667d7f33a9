"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name no entity, articles that are cut from a name's front, words without weight in a summary.
NO_ENTITY = """The This That These Those There Where When What Who How Why But And For With From Into Their Some Most Many More
Less It Its An A Is Are Was Were Be Been Being Have Has Had Will Would Could Should May Might Must Shall Can Cannot In On At By
To Of If As So Or Not Now Then Also Just Even Still Yet After Before While Because Since Until Round Part Step Section Chapter
Figure Table Page Note Notes First Second Third Next Last Final One Two Three Working Building Getting Including According
Based""".split()
ARTICLES = "The A An This That These Those By In On Of Our Their His Her Its".split()
LIGHT_WORDS = """this that with from have they their there which would could should about these those been were what when where
your will more than into also such some many most other even only very much like""".split()

SENTENCE_END = r"(?<=[.!?])\s+"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def nonblank(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def normalize(c: Column) -> Column:
    """One kind of line end, at most one blank line, single spaces, stripped."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def collapse(c: Column) -> Column:
    """Lower case, single spaces: for comparing answers."""
    return F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), r"\s+", " ")


def slug(c: Column) -> Column:
    """For names in the graph: hyphens go, runs of spaces become one; the cut at 60 comes after trimming."""
    s = F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), r"^-+|-+$", ""), 1, 60)


def skill_slug(c: Column) -> Column:
    """For skills: hyphens stay and merge with spaces."""
    s = F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s-]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(s, r"[\s-]+", "-"), r"^-+|-+$", ""), 1, 60)


def url_slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^https?://", "")
    s = F.substring(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 80)
    return F.when(s == "", "doc").otherwise(s)


def domain(c: Column) -> Column:
    host = F.regexp_extract(F.lower(c), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def is_url(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def preview(c: Column, n: int = 200, trimmed: bool = True) -> Column:
    c = F.coalesce(c, F.lit(""))
    c = strip(c) if trimmed else c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def snippet(c: Column, n: int = 280) -> Column:
    """The start of a text, cut at its last space and marked if anything follows."""
    lead = strip(F.substring(c, 1, n))
    cut = F.concat(F.when(lead.contains(" "), F.regexp_extract(lead, r"(?s)^(.*) ", 1)).otherwise(lead), F.lit("…"))
    return F.when(F.length(c) > F.length(lead), cut).otherwise(lead)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def keywords(c: Column) -> Column:
    """Distinct tokens of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def keyword_similarity(query: Column, text: Column) -> Column:
    """Share of the query's keywords that the text has; 0 for a query without any."""
    q = keywords(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, keywords(text))) / F.size(q))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda s: s != "")


def lines_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), strip), lambda s: s != "")


def gist(c: Column, n: int = 400) -> Column:
    """Prose of an answer without headings, blank lines and the list of sources at its end."""
    body = F.element_at(F.split(F.coalesce(c, F.lit("")), r"(?i)\n#{1,6}\s*(?:Key sources|Citations|Sources)\b", 2), 1)
    return strip(F.substring(F.array_join(F.filter(lines_of(body), lambda s: ~s.startswith("#")), " "), 1, n))


def name_key(c: Column) -> Column:
    """Names that differ in case, spaces or marks alone have one key."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("long")


def overlap_tail(c: Column, n: int) -> Column:
    """The last n characters, from the first space on if that lies in the first half."""
    if n <= 0:
        return F.lit("")
    tail = F.substring(c, -n, n)
    space = F.instr(tail, " ") - 1
    cut = F.when((space > 0) & (space < n // 2), F.substr(tail, space + 2)).otherwise(tail)
    return F.when(F.length(c) <= n, c).otherwise(strip(cut))


def has_placeholder(c: Column) -> Column:
    # fixed value: what marks an unfinished text
    return c.rlike(r"(?i)\b(TODO|TBD|FIXME|XXX|lorem ipsum|your (?:skill|task|tool) here|placeholder)\b|<[a-z_]{3,}>")


def numbered_steps(c: Column) -> Column:
    # fixed value: what begins a step
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?m)^\s*(?:\d+[.)]|[-*])\s+\S"))


#: Fixed value: verbs in a tool's name that change something.
WRITING_TOOL = r"(?i)(^|[_.\-])(create|update|delete|write|insert|upsert|put|post|remove|drop|set|add|edit|apply|merge|execute|deploy|pause|restore|reset|rebase)([_.\-]|$)"


def mutating_tool(name: Column) -> Column:
    """Tools whose name has a verb that writes."""
    return name.rlike(WRITING_TOOL)


def identifier(c: Column) -> Column:
    """A safe name for a schema or table."""
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "")


def metric_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
