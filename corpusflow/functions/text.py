"""Text functions, Column -> Column, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns and word lists that results depend on.
HASHTAG = r"(?iU)(?:^|\s)#([a-z][\w/-]*)"
WIKILINK = r"\[\[([^\]|#]+?)(?:\|[^\]]+)?\]\]"
CAP_PHRASE = r"(?U)\b([A-Z][a-zA-Z0-9]+(?:[ -][A-Z][a-zA-Z0-9]+){1,3})\b"
KEBAB_TOKEN = r"(?U)\b([a-z][a-z0-9]+(?:-[a-z0-9]+){1,4})\b"
THREAD_TAG = r"#thread/([A-Za-z0-9_-]+)"
THREAD_TAG_LOWER = r"#thread/([a-z0-9][a-z0-9-]*)"
GOVERNANCE = ("thread/", "client/", "status/", "area/", "project/")
NOISE = (
    "next-steps", "action-items", "follow-up", "follow-ups", "click-here", "view-meeting", "view-here", "high-priority",
    "low-priority", "medium-priority", "to-do", "to-dos", "todo", "todos", "in-progress", "done", "not-started",
)
GENERIC_TOKENS = ("the", "and", "for", "inn", "lodge", "hotel", "project", "roll", "up", "in")
QUESTION_STOPWORDS = (
    "the", "and", "for", "are", "was", "what", "whats", "with", "from", "this", "that", "have", "has", "how", "does", "did",
    "about", "into", "over", "any", "all", "our", "out", "who", "why", "when", "where", "which", "their", "they", "been",
    "were", "will", "would", "could", "should", "than", "then", "them", "your", "you", "get", "got", "can", "but", "not",
    "its", "his", "her", "show", "tell", "give", "list", "find", "summarize", "summary", "status", "current", "key",
    "decisions", "decision", "happening", "going",
)


def _any(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column) -> Column:
    """Without white space at either end, line feeds too."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def kebab(c: Column) -> Column:
    """Words joined by single hyphens, ASCII only."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"(?U)[\s_]+", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9-]", ""), "-+", "-"), F.lit("-"))


def fuzzy_key(c: Column) -> Column:
    """What is left of a name for comparison: a-z and 0-9."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def squash(c: Column) -> Column:
    """Lower case without hyphens, underscores and blanks: looser than fuzzy_key on other marks."""
    return F.regexp_replace(F.lower(c), r"(?U)[-_\s]", "")


def slugify(c: Column, most: int | None = None) -> Column:
    """A title as a file name: Unicode word characters, runs of blanks and hyphens as one."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\s-]", "")
    c = F.trim(F.regexp_replace(c, r"(?U)[\s_-]+", "-"), F.lit("-"))
    return F.rtrim(F.substring(c, 1, most), F.lit("-")) if most else c


def plain_slug(c: Column) -> Column:
    """Runs of anything but letters, digits and hyphens as one hyphen; hyphens stay as they are."""
    return F.lower(F.trim(F.regexp_replace(c, "[^a-zA-Z0-9-]+", "-"), F.lit("-")))


def tokens(c: Column, generic: Iterable[str] = GENERIC_TOKENS) -> Column:
    """Distinct parts of a slug of three characters or more, without generic ones, sorted."""
    parts = F.split(F.lower(c), "[^a-z0-9]+")
    return F.array_sort(F.array_except(F.array_distinct(F.filter(parts, lambda x: F.length(x) >= 3)), _any(generic)))


def question_terms(c: Column, most: int = 8, stop: Iterable[str] = QUESTION_STOPWORDS) -> Column:
    """The search terms of a question, in order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([A-Za-z0-9][A-Za-z0-9'\-]+)"), F.lit(1))
    found = F.filter(F.transform(found, lambda x: F.trim(x, F.lit("'-"))), lambda x: F.length(x) >= 3)
    return F.slice(F.array_except(found, _any(stop)), 1, most)


def extract(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def hashtags(c: Column, governance: Iterable[str] = GOVERNANCE) -> Column:
    """Tags in lower case, without those that carry governance."""
    import re

    prefix = "^(?:" + "|".join(map(re.escape, governance)) + ")"
    return F.filter(F.transform(extract(c, HASHTAG), lambda x: F.lower(x)), lambda x: ~x.rlike(prefix))


def candidates(c: Column) -> Column:
    """Slugs that a text offers as names of patterns: tags, links, capitalised phrases and
    kebab tokens; distinct."""
    links = F.filter(F.transform(extract(c, WIKILINK), lambda x: F.trim(x)), lambda x: ~x.rlike(r"^\d{4}-\d{2}-\d{2}"))
    tags = F.transform(hashtags(c), lambda x: kebab(F.replace(x, F.lit("/"), F.lit("-"))))
    return F.array_distinct(F.concat(tags, F.transform(links, kebab), F.transform(extract(c, CAP_PHRASE), kebab), extract(F.lower(c), KEBAB_TOKEN)))


def title_case(c: Column) -> Column:
    """my-slug -> My Slug."""
    return F.array_join(F.transform(F.split(c, "-"), F.initcap), " ")


def title_case_company(c: Column) -> Column:
    """Capitalised only where the name is all lower case."""
    return F.when(c == F.lower(c), F.initcap(c)).otherwise(c)


def extract_email(c: Column) -> Column:
    """<...> first, else a bare address, else the text in lower case."""
    address = r"([A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+)"
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(c, f"<{address}>", 1), F.lit("")), F.nullif(F.regexp_extract(c, address, 1), F.lit("")), F.trim(c)))


def normalize_email(c: Column) -> Column:
    """Lower case; null unless it has an @ and no blank."""
    e = F.lower(F.trim(c))
    return F.when(e.contains("@") & ~e.rlike(r"\s"), e)


def derive_name(local: Column) -> Column:
    """jane.doe42 -> Jane Doe; where nothing is left of it, the local part as it is."""
    return F.array_join(F.transform(_name_parts(local), F.initcap), " ")


def _name_parts(local: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(local, r"\d+$", ""), r"[._\-+]+"), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(local))


def person_slug(local: Column) -> Column:
    """jane.doe42 -> jane-doe."""
    return F.regexp_replace(F.lower(F.array_join(_name_parts(local), "-")), "[^a-z0-9-]", "")


def person_file(slug: Column) -> Column:
    """jane-doe -> Jane-Doe, the name of a person's file."""
    return F.array_join(F.transform(F.filter(F.split(slug, "-"), lambda x: x != ""), F.initcap), "-")


def company_short(domain: Column) -> Column:
    """The label left of the last dot, its last part: mail.acme.io -> acme, a.co.uk -> co."""
    left = F.regexp_replace(F.lower(domain), r"\.[^.]*$", "")
    return F.regexp_replace(F.element_at(F.split(left, r"\."), -1), "[^a-z0-9]", "")


#: What counts as a secret, in the order of replacement.
SECRETS = (
    (r"sk-[A-Za-z0-9]{20,}", "sk-REDACTED"),
    (r"ghp_[A-Za-z0-9]{36}", "ghp_REDACTED"),
    (r"AKIA[0-9A-Z]{16}", "AKIA_REDACTED"),
    (r"xoxb-[A-Za-z0-9-]{30,}", "xoxb-REDACTED"),
    (r"Bearer [A-Za-z0-9._-]{30,}", "Bearer REDACTED"),
    (r"(?i)password\s*[=:]\s*\S+", "password=REDACTED"),
    (r"(?i)api[_-]?key\s*[=:]\s*\S+", "api_key=REDACTED"),
)


def redact(c: Column, patterns: Iterable[tuple[str, str]] = SECRETS) -> Column:
    """struct(text, n): secrets replaced one pattern after another; n patterns that changed it."""
    n = F.lit(0)
    for pattern, to in patterns:
        was, c = c, F.regexp_replace(c, pattern, to)
        n = n + F.when(c != was, 1).otherwise(0)
    return F.struct(c.alias("text"), n.cast("long").alias("n"))


def truncate(c: Column, n: int = 200) -> Column:
    """Line feeds as blanks; at most n characters, the last one an ellipsis."""
    c = F.trim(F.replace(c, F.lit("\n"), F.lit(" ")))
    return F.coalesce(F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c), F.lit(""))


def excerpt(body: Column, n: int) -> Column:
    """Without the first first-level heading, white space as one blank; n characters and an ellipsis."""
    c = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?sm)\A(.*?)^#\s+[^\n]+$", "$1"), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def yaml_str(c: Column) -> Column:
    """A scalar for frontmatter: quoted where YAML would read it another way."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    odd = c.rlike(r"""[:#\[\]{}",&*!|>%@`'\n]""") | c.rlike(r"^\s|\s$|^-") | (c == "") | F.lower(c).isin("true", "false", "null", "yes", "no")
    return F.when(c.isNull(), F.lit("")).when(odd, F.replace(quoted, F.lit("\n"), F.lit(" "))).otherwise(c)


def yaml_list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, yaml_str), ", "), F.lit("]"))


def _escaped(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, r'([\\"])', r"\\$1"), F.lit('"'))


def yaml_quoted(c: Column) -> Column:
    """Always quoted; line feeds as blanks, null as empty."""
    return _escaped(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", " ")))


#: Words that YAML reads as no text.
YAML_RESERVED = ("null", "none", "true", "false", "yes", "no", "on", "off", "~")


def yaml_plain_safe(c: Column) -> Column:
    """Whether a text may stand in a list unquoted: it looks plain, and is neither a word nor a number of
    YAML's own."""
    shape = c.rlike(r"^[A-Za-z0-9][A-Za-z0-9 ._/&()+'-]*[A-Za-z0-9.)']$")
    return shape & ~F.lower(c).isin(*YAML_RESERVED) & ~c.rlike(r"^[0-9][0-9._]*$")


def yaml_inline_list(c: Column) -> Column:
    """[a, "b: c"]: items quoted where they aren't plain."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.when(yaml_plain_safe(x), x).otherwise(_escaped(x))), ", "), F.lit("]"))


def yaml_scalar(c: Column) -> Column:
    """A scalar of a book's note: quoted where a mark could confuse."""
    odd = c.rlike(r"""[:#\[\]{}&*!|>'"%@`,]""") | c.rlike(r"^[-?]") | (c != F.trim(c))
    return F.when(c == "", F.lit('""')).when(odd, _escaped(c)).otherwise(c)


def yaml_block(key: str, values: Column) -> Column:
    """key: [] or a block list, items in single quotes where a plain scalar would be misread."""
    odd = lambda x: (x == "") | x.rlike(r"""^[\[\]{}>|*&!%@#,"'`-]""") | x.contains(": ") | (x != F.trim(x))
    item = lambda x: F.when(odd(x), F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(x)
    return F.when(F.size(values) == 0, F.lit(f"{key}: []")).otherwise(F.concat(F.lit(f"{key}:\n- "), F.array_join(F.transform(values, item), "\n- ")))


def title(body: Column, fallback: Column) -> Column:
    """The first first-level heading."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(body, r"(?m)^#[\x20\t]+(.+)$", 1)), F.lit("")), fallback)


def clean_title(c: Column) -> Column:
    """Without a leading date and a duration in parentheses."""
    c = F.regexp_replace(c, r"^\d{4}-\d{2}-\d{2}\s*[—-]?\s*", "")
    return F.trim(F.regexp_replace(c, r"(?i)\s*\([^)]*\d+\s*[smh][^)]*\)\s*", " "))


def section(body: Column, heading: str, needs_next: bool = False) -> Column:
    """The text under ``## heading`` up to the next such heading, or the text's end."""
    end = r"(?=^## )" if needs_next else r"(?=^## |\z)"
    return strip(F.regexp_extract(body, rf"(?ms)^## {heading}[\x20\t]*\n(.*?){end}", 1))


def replace_section(body: Column, heading: str, new: Column) -> Column:
    """body with the section put anew, or added at the end."""
    pattern = rf"(?ms)^## {heading}$.*?(?=^## |\z)"
    text = F.concat(F.lit(f"## {heading}\n\n"), new, F.lit("\n\n"))
    literal = F.regexp_replace(text, r"([\\$])", r"\\$1")
    return F.when(body.rlike(pattern), F.regexp_replace(body, F.lit(pattern), literal)).otherwise(F.concat(body, F.lit("\n"), text))


def demote_headings(body: Column, by: int = 1) -> Column:
    """Headings deeper by so many levels, six at most, outside code fences."""
    lines = F.split(body, "\n")
    fence = F.transform(lines, lambda x: F.startswith(x, F.lit("```")).cast("int"))
    out = F.transform(
        lines,
        lambda x, i: F.when(
            x.rlike(r"^#{1,6} ") & (F.aggregate(F.slice(fence, F.lit(1), i), F.lit(0), lambda a, b: a + b) % 2 == 0),
            F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.length(F.regexp_extract(x, "^(#+)", 1)) + by)), F.regexp_replace(x, "^#+", "")),
        ).otherwise(x),
    )
    return F.array_join(out, "\n")


def contains_terms(c: Column, terms: Iterable[str]) -> Column:
    """Whether a whole word of terms (four letters or more) is in the text, in any case."""
    import re

    words = [re.escape(t) for t in terms if len(t) >= 4]
    return c.rlike(r"(?iU)\b(?:" + "|".join(words) + r")\b") if words else F.lit(False)


def term_window(title_: Column, body: Column, first: int) -> Column:
    """What terms are looked for in: the title and the first characters of the body."""
    return F.concat(F.coalesce(title_, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, first))


def clip(c: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis; line feeds stay."""
    c = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def book_slug(c: Column) -> Column:
    """ASCII letters and digits, runs of anything else as one hyphen."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def _fenced_lines(body: Column) -> Column:
    """Lines with whether they stand in a code fence or are one: array<struct<x, fenced>>. The body is cut before
    each fence; every other part is inside, so no line looks back at those before it."""
    return let(F.split(F.concat(F.lit("\n"), F.replace(body, F.lit("\r\n"), F.lit("\n"))), "\n(?= *```)"), _marked)


def _marked(parts: Column) -> Column:
    first = F.when(parts[0] == "", F.slice(F.split(F.lit(""), "\n"), 1, 0)).otherwise(F.split(F.substr(parts[0], F.lit(2)), "\n"))
    outside = F.transform(first, lambda x: F.struct(x.alias("x"), F.lit(False).alias("fenced")))
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p, i: F.transform(F.split(p, "\n"), lambda x, j: F.struct(x.alias("x"), ((i % 2 == 0) | (j == 0)).alias("fenced"))))
    return F.concat(outside, F.flatten(rest))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, also where a function of an array names it for each element."""
    return F.transform(F.array(value), use)[0]


def spine(body: Column) -> Column:
    """Headings deeper by as many levels as make the shallowest the third, six at most, outside
    code fences; a body without headings above the third stays."""
    level = lambda x: F.when(~x["fenced"] & x["x"].rlike(r"^#{1,6}\s+"), F.length(F.regexp_extract(x["x"], "^(#+)", 1)))
    deeper = lambda x, shift: F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), level(x) + shift)), F.lit(" "), F.trim(F.regexp_replace(x["x"], r"^#+\s+", "")))
    put = lambda lines, shift: F.array_join(F.transform(lines, lambda x: F.when(level(x).isNotNull(), deeper(x, shift)).otherwise(x["x"])), "\n")
    moved = let(_fenced_lines(body), lambda lines: let(F.lit(3) - F.array_min(F.transform(lines, level)), lambda shift: F.when(shift > 0, put(lines, shift))))
    return strip(F.coalesce(moved, body))


def next_steps(body: Column) -> Column:
    """The number of bullets below a heading (or a bold line) that reads next steps or action
    items, up to the next heading of its level, outside code fences."""
    bold = r"^\*\*(.+?)\*\*:?\s*$"
    state = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("level"))

    def step(a: Column, x: Column) -> Column:
        line = x["x"]
        head = line.rlike(r"^#{1,6}\s+")
        at = F.when(head, F.length(F.regexp_extract(line, "^(#+)", 1))).when(F.trim(line).rlike(bold), 7)
        title = F.when(head, F.regexp_replace(line, r"^#+\s+", "")).otherwise(F.regexp_extract(F.trim(line), bold, 1))
        level = F.when(at.isNull(), a["level"]).when(title.rlike("(?i)next steps|action items"), at).when(at > a["level"], a["level"])
        hit = at.isNull() & a["level"].isNotNull() & line.rlike(r"^\s*(?:[-*+]|\d+[.)])\s+\S")
        return F.when(x["fenced"], a).otherwise(F.struct((a["n"] + F.when(hit, 1).otherwise(0)).alias("n"), level.alias("level")))

    return F.aggregate(_fenced_lines(body), state, step, lambda a: a["n"])


def month_line(c: Column) -> Column:
    """A line such as March 4, 2024 or Mar 4, 2024 as a date; else null."""
    x = F.regexp_replace(F.regexp_replace(strip(c), r"^[A-Za-z]+day,\s*", ""), r"^([A-Za-z]{3})[a-z]*\.?", "$1")
    return F.try_to_timestamp(x, F.lit("MMM d, yyyy")).cast("date")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
