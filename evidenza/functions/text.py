"""Text, identity and value functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[ \\t\\u00a0\\u3000]+"
EDGES = " \t\n\r\x0b\x0c 　"
#: The URL namespace of name-based identifiers.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def bound(c: Column, of) -> Column:
    """of(c), with c computed once."""
    return F.transform(F.array(c), of)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(EDGES))


def clean_chunk(c: Column) -> Column:
    """Carriage returns to newlines, blanks squashed in each line, blank lines dropped."""
    lines = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n", -1)
    squashed = F.transform(lines, lambda x: strip(F.regexp_replace(x, BLANKS, " ")))
    return F.array_join(F.filter(squashed, lambda x: x != ""), "\n")


def clean_report(c: Column) -> Column:
    """Blanks squashed, three or more newlines to two, edges stripped."""
    one = F.regexp_replace(F.regexp_replace(c, "\r", "\n"), BLANKS, " ")
    return strip(F.regexp_replace(one, "\n{3,}", "\n\n"))


def number_text(c: Column) -> Column:
    """A double as its shortest digits: in full from 0.0001 to below 10^16, else with an exponent of two digits or more."""
    size, said = F.abs(c), c.cast("string")
    whole = F.regexp_replace(F.rtrim(c.cast("decimal(38,21)").cast("string"), F.lit("0")), "\\.$", ".0")
    short = F.regexp_replace(F.regexp_replace(said, "\\.0E", "E"), "E-(\\d)$", "E-0$1")
    power = F.regexp_replace(F.regexp_replace(short, "E-", "e-"), "E", "e+")
    return F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), said).when((size >= 1e-4) & (size < 1e16), whole).when(F.isnan(c) | (size == float("inf")), said).otherwise(power)


#: Spaces that a scan may hold; newlines are not among them.
SCAN_SPACES = " \t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u3000\ufeff"


def clean_scan(c: Column) -> Column:
    """Spaces between ideographs dropped, other spaces squashed, edges stripped; newlines stay."""
    han = "\\u4e00-\\u9fff"
    inner = F.regexp_replace(c, f"(?<=[{han}])[{SCAN_SPACES}]+(?=[{han}])", "")
    return F.btrim(F.regexp_replace(inner, f"[{SCAN_SPACES}]+", " "), F.lit(SCAN_SPACES))


def effective_line(line: Column) -> Column:
    """Neither empty nor a bare page number, with or without dashes."""
    return (line != "") & ~line.rlike(r"^[-–—]?\s*\d+\s*[-–—]?$")


def clean_body(c: Column) -> Column:
    """Lines of a scan, cleaned: those that are effective and differ from the last one kept."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(c, "\r", "\n"), "\n", -1), clean_scan), effective_line)
    return F.array_join(F.filter(lines, lambda x, i: (i == 0) | (x != F.coalesce(F.try_element_at(lines, i), F.lit("")))), "\n")


def picked_title(body: Column) -> Column:
    """The first effective line of 2 to 40 characters that isn't digits only; none: empty."""
    fits = F.filter(F.transform(F.split(body, "\n", -1), clean_scan), lambda x: F.length(x).between(2, 40) & ~x.rlike("^\\d+$") & effective_line(x))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(""))


def search_text(title: Column, body: Column) -> Column:
    """Title and body, which loses a first line that is the title."""
    return F.btrim(F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(without_title_line(body, title), F.lit(""))), F.lit("\n "))


def section_title(title: Column, page: Column) -> Column:
    """The cleaned title, or the page by its number."""
    said = clean_chunk(F.coalesce(title, F.lit("")))
    return F.when(said != "", said).otherwise(F.concat(F.lit("PDF第"), F.coalesce(page, F.lit(0)).cast("string"), F.lit("页")))


def page_text(title: Column, body: Column, table: Column, figure: Column, search: Column) -> Column:
    """Body without its title line, table and figure text, a blank line between; without any of them the search text."""
    text = lambda c: clean_chunk(F.coalesce(c, F.lit("")))
    own = [text(without_title_line(F.coalesce(body, F.lit("")), title)), text(table), text(figure)]
    parts = F.concat_ws("\n\n", *[bound(x, lambda t: F.nullif(t, F.lit(""))) for x in own])
    return bound(parts, lambda said: F.when(said != "", said).otherwise(text(without_title_line(F.coalesce(search, F.lit("")), title))))


def processable(searchable: Column, *texts: Column) -> Column:
    """searchable is true and some text isn't blank."""
    return F.coalesce(searchable, F.lit(False)) & (strip(F.concat_ws("", *texts)) != "")


def page_tags(page: Column, model: Column, printed: Column, source: str = "msd") -> Column:
    """Tags of a chunk: source, page, model and, if there is one, the printed page."""
    tag = lambda name, c: F.concat(F.lit(f"{name}:"), F.coalesce(c.cast("string"), F.lit("")))
    return F.array_compact(F.array(F.lit(f"source:{source}"), tag("pdf_page", F.coalesce(page, F.lit(0))), tag("model", model), F.when(printed.cast("string") != "", tag("printed_page", printed))))


def report_line(c: Column) -> Column:
    """Full-width marks to ASCII, separators to one space."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.translate(c, "：（）", ":()"), "[|｜,，;；]+", " "), "\\s+", " "))


def content_of(title: Column, body: Column) -> Column:
    """Title, newline, body; one of them if the other is blank or the same."""
    def joined(x: Column) -> Column:
        t, b = x["t"], x["b"]
        return F.when((b == "") | (b == t), t).when(t == "", b).otherwise(F.concat_ws("\n", t, b))

    return bound(F.struct(clean_chunk(title).alias("t"), clean_chunk(body).alias("b")), joined)


def without_title_line(text: Column, title: Column) -> Column:
    """The text without its first non-blank line, if that is the title."""
    rest = lambda lines: F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    return bound(F.split(clean_chunk(text), "\n", -1), lambda lines: F.when(lines[0] == strip(title), rest(lines)).otherwise(F.array_join(lines, "\n")))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def chunk_id(document: Column, page: Column, index: Column, content_hash: Column) -> Column:
    return sha256(F.concat_ws("|", document, page.cast("string"), index.cast("string"), content_hash))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """A name-based identifier: SHA-1 of namespace and name, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def slug(c: Column, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.translate(F.lower(F.btrim(c)), " ", "_"), "[^\\p{L}\\p{N}_]", ""), 1, most)


def middle_ellipsis(c: Column, most: int) -> Column:
    head = (most - 1 + 1) // 2
    tail = most - 1 - head
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit("…"), F.right(c, F.lit(tail))))


def byte_format(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / float(1 << 20)))


def confidence(c: Column) -> Column:
    """Missing: 1; not a number: 0."""
    return F.when(c.isNull(), F.lit(1.0)).otherwise(F.coalesce(c.try_cast("double"), F.lit(0.0)))


def printed_page(page: Column, offset: int) -> Column:
    return F.when(page - offset >= 1, (page - offset).cast("string"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def string_list(c: Column) -> Column:
    """A JSON array of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def box_edges(box: Column) -> Column:
    """left, top, right, bottom of a box of points."""
    x, y = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    return F.struct(F.array_min(x).alias("left"), F.array_min(y).alias("top"), F.array_max(x).alias("right"), F.array_max(y).alias("bottom"))


def percent(value: Column, whole: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), value / whole * 100.0))
