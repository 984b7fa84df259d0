"""WARC derivatives (operator 1): a metadata and a conversion record for each response.

Input rows are response records: record_id, target_uri, warc_date, http_headers (status line
and header lines, CRLF) and payload (the page).  Each gives

* a ``metadata`` record of ``application/warc-fields``: title, language, source status and
  content type, the payload's digest, and every outlink in page order;
* a ``conversion`` record of ``text/plain``: the visible text, one line a block element.

Both name the response in WARC-Refers-To, keep its target, date and source headers, and
carry a digest of their own block and the digest of the payload they were made from.  Record
ids are UUIDs of the kind and the response's id, so a repeated run makes the same records.
The visible text comes from an Arrow function, the rest from built-in SQL functions: one
scan, no shuffle.

Defined results: null payload is an empty page, null headers are empty; a null target stays
null; a repeated response makes repeated records with equal ids; a page without text makes a
conversion record of length 0; malformed markup (``<`` without ``>``) stays text; white space is collapsed, also
where references stand for it; entities
other than lt, gt, quot, apos, nbsp, amp and numbers stay as written, and each reference is
decoded once; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprofile.llm.common import shared_path, slices, stored

WHITE = r"[ \t\n\x0B\f\r]"
#: elements whose content isn't text, and elements that end a line
SILENT = "script|style|noscript|template|svg|head|title"
LINES = ("address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|"
         "main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul")
ENTITIES = [("lt;", "<"), ("gt;", ">"), ("quot;", '"'), ("apos;", "'"), ("nbsp;", "\xa0"), ("amp;", "&")]
TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
LANG = rf"(?i)<html\b[^>]*\blang{WHITE}*={WHITE}*[\"']?([a-zA-Z0-9-]+)"
LINK = rf"(?i)<a\b[^>]*\bhref{WHITE}*={WHITE}*[\"']([^\"'>]*)[\"']"
STATUS, KIND = r"^HTTP/[0-9.]+ ([0-9]{3})", r"(?i)content-type:[ \t]*([^\r\n]*)"
DATE = "2024-01-01T00:00:00Z"


def _character(piece: Column) -> Column:
    """The text after ``#`` of a reference with a valid number decoded, else with the mark put back."""
    decimal, hexed = F.regexp_extract(piece, "^([0-9]{1,7});", 1), F.regexp_extract(piece, "^[xX]([0-9a-fA-F]{1,6});", 1)
    n = F.when(decimal != "", decimal.cast("long")).when(hexed != "", F.conv(hexed, 16, 10).cast("long")).otherwise(0)
    valid = ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n <= 0x10FFFF))
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(valid, F.concat(char, F.regexp_replace(piece, "^[0-9a-fA-FxX]+;", ""))).otherwise(F.concat(F.lit("&#"), piece))


def _reference(piece: Column) -> Column:
    """The text after an ``&`` with the reference it begins with decoded, if it is one."""
    out = F.when(F.startswith(piece, F.lit("#")), _character(F.substring(piece, 2, 2 ** 31 - 1)))
    for entity, char in ENTITIES:
        out = out.when(F.startswith(piece, F.lit(entity)), F.concat(F.lit(char), F.substring(piece, len(entity) + 1, 2 ** 31 - 1)))
    return out.otherwise(F.concat(F.lit("&"), piece))


def _joined(parts: Column) -> Column:
    """A text split at ``&``, with references decoded once; ``parts`` stands in three places."""
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), _reference), ""))


def unescaped(c: Column) -> Column:
    """For short texts, as ``c`` stands in several places."""
    return F.when(F.instr(c, "&") > 0, _joined(F.split(c, "&"))).otherwise(c)


class PageText:
    """The visible text of pages, as UTF-8 bytes: markup in one pass over each page, the first
    construct to begin wins; then references; then white space."""

    def __init__(self):
        import re
        #: 1 silent element or comment, 2 line element, neither: another tag
        self.markup = re.compile(rf"""(?s)<(?:(!--.*?-->|(?i:(?P<name>{SILENT})\b[^>]*>.*?</(?P=name)[ \t-\r]*>))
            |(/?(?i:{LINES})\b[^>]*>)|/?[a-zA-Z!?][^>]*>)""".replace("\n            ", "").encode())
        self.reference = re.compile(b"&(?:(%s)|#([0-9]{1,7});|#[xX]([0-9a-fA-F]{1,6});)" % "|".join(e for e, _ in ENTITIES).encode())
        self.named = {e.encode(): c.encode() for e, c in ENTITIES}

    @staticmethod
    def mark(m) -> bytes:
        if m[1]:
            return b" "
        return b"\xff" if m[3] else b""  # no byte of UTF-8 text

    def character(self, m) -> bytes:
        if m[1]:
            return self.named[m[1]]
        n = int(m[2]) if m[2] else int(m[3], 16)
        return chr(n).encode() if 0 < n < 0xD800 or 0xDFFF < n < 0x110000 else m[0]

    def text(self, page: bytes) -> bytes:
        out = self.markup.sub(self.mark, page)
        if b"&" in out:
            out = self.reference.sub(self.character, out)
        lines = (b" ".join(line.split()) for line in out.split(b"\xff"))  # bytes.split() knows ASCII white space alone
        return b"\n".join(line for line in lines if line)


def plain_text(html: Column) -> Column:
    """The visible text of a page, one line a block element; an Arrow function, which reads each
    page once where SQL functions need a pass over it for each kind of markup."""
    state = {}

    @F.arrow_udf("string")
    def text_of(pages: pa.Array) -> pa.Array:
        if not state:
            state["of"] = PageText().text
        of = state["of"]
        return pa.array([None if p is None else of(p) for p in pages.cast(pa.binary()).to_pylist()], pa.binary()).view(pa.string())

    return text_of(html)


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"{WHITE}+", " "))


def urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of raw pages (page_id, url, html)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                       F.octet_length(html).cast("string"), F.lit("\r\n"))
    return pages.select(urn(F.lit("response"), F.col("url").cast("string"), F.col("page_id").cast("string")).alias("record_id"),
                        F.col("url").cast("string").alias("target_uri"), F.lit(DATE).alias("warc_date"),
                        headers.alias("http_headers"), html.alias("payload"))


def derivatives(response: DataFrame) -> DataFrame:
    """Two records for each response: warc_type, record_id, refers_to, target_uri, warc_date,
    content_type, content_length (bytes), block_digest, source_digest, source_headers, block."""
    page = response.select("record_id", "target_uri", "warc_date", F.coalesce("http_headers", F.lit("")).alias("headers"),
                           F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("payload"))
    links = F.transform(F.regexp_extract_all("payload", F.lit(LINK), 1), lambda x: F.concat(F.lit("outlink: "), one_line(unescaped(x))))
    found = page.select("*", digest(F.col("payload")).alias("source_digest"), plain_text(F.col("payload")).alias("text"), links.alias("links"),
                        one_line(unescaped(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), "<[^>]*>", ""))).alias("title"),
                        F.lower(F.regexp_extract("payload", LANG, 1)).alias("language"))
    fields = F.concat(F.concat_ws("\r\n", F.concat(F.lit("title: "), F.col("title")), F.concat(F.lit("language: "), F.col("language")),
                                  F.concat(F.lit("source-status: "), F.regexp_extract("headers", STATUS, 1)),
                                  F.concat(F.lit("source-content-type: "), F.regexp_extract("headers", KIND, 1)),
                                  F.concat(F.lit("source-payload-digest: "), F.col("source_digest")),
                                  F.concat(F.lit("outlinks: "), F.size("links").cast("string")), "links"), F.lit("\r\n"))

    def record(kind, content_type, block):
        return F.struct(F.lit(kind).alias("warc_type"), F.lit(content_type).alias("content_type"), block.alias("block"))

    both = found.select("record_id", "target_uri", "warc_date", "headers", "source_digest", F.explode(F.array(
        record("metadata", "application/warc-fields", fields),
        record("conversion", "text/plain; charset=utf-8", F.col("text")))).alias("r"))
    return both.select("r.warc_type", urn(F.col("r.warc_type"), F.col("record_id")).alias("record_id"),
                       F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "r.content_type",
                       F.octet_length("r.block").cast("long").alias("content_length"), digest(F.col("r.block")).alias("block_digest"),
                       "source_digest", F.col("headers").alias("source_headers"), "r.block")


def record_bytes(records: DataFrame) -> DataFrame:
    """Each record as the bytes of a WARC 1.1 record, column ``data``."""
    def line(name, c):
        return F.concat(F.lit(f"{name}: "), c)

    def bracketed(c):
        return F.concat(F.lit("<"), c, F.lit(">"))

    source = F.transform(F.filter(F.split("source_headers", "\r\n"), lambda x: x != ""), lambda x: F.concat(F.lit("X-Source-Header: "), x))
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", bracketed(F.col("record_id"))),
                       line("WARC-Refers-To", bracketed(F.col("refers_to"))), line("WARC-Target-URI", F.col("target_uri")),
                       line("WARC-Date", F.col("warc_date")), line("WARC-Block-Digest", F.col("block_digest")),
                       line("X-Source-Payload-Digest", F.col("source_digest")), source, line("Content-Type", F.col("content_type")),
                       line("Content-Length", F.col("content_length").cast("string")))
    return records.select("record_id", F.concat(head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n")).cast("binary").alias("data"))


def write(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``.warc.gz`` files, one gzip member a record, one file a partition.  Returns the
    stored manifest (path, records, bytes), which alone says what files count."""
    import uuid

    from tabprofile.llm.records import open_store
    folder = folder or shared_path(records.sparkSession, "warc")

    def task(batches):
        import gzip

        import pyarrow as pa
        out, name, n, size = None, "", 0, 0
        try:
            for batch in batches:
                for b in slices(batch):
                    for data in b.column(1).to_pylist():
                        if out is None:
                            store, base = open_store(folder)
                            store.create_dir(base, recursive=True)
                            name = f"{uuid.uuid4().hex}.warc.gz"
                            out = store.open_output_stream(f"{base}/{name}", compression=None)
                        member = gzip.compress(data, 6, mtime=0)
                        out.write(member)
                        n, size = n + 1, size + len(member)
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n, "bytes": size}])

    return stored(record_bytes(records).mapInArrow(task, "path string, records long, bytes long"), "warc-manifest")


def oracle_sql() -> str:
    """DuckDB SQL for ``derivatives(responses(pages))`` over the table pages."""
    w = r"[ \t\n\x0B\f\r]"
    elements = "script style noscript template svg head title"
    lines = ("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h[1-6] header hr html li main nav ol "
             "option p pre section table tbody td tfoot th thead title tr ul")
    strip = [(r"(?s)<!--.*?-->", " "), *[(rf"(?is)<{e}\b[^>]*>.*?</{e}{w}*>", " ") for e in elements.split()], (rf"{w}+", " "),
             (rf"(?i)</?(?:{lines.replace(' ', '|')})\b[^>]*>", "\ue000"), (r"</?[a-zA-Z!?][^>]*>", "")]
    tidy = [(rf"{w}+", " "), ("[ \ue000]*\ue000[ \ue000]*", "\n"), (r"\A[ \n]+", ""), (r"[ \n]+\z", "")]

    def q(s):
        return "'" + s.replace("'", "''") + "'"

    def lit(s):  # control characters by chr(), which every client passes on
        return {"\n": "chr(10)", "\ue000": "chr(57344)", "\r\n": "(chr(13) || chr(10))", "\xa0": "chr(160)"}.get(s, q(s))

    def replaced(e, steps):
        for pattern, by in steps:
            e = f"regexp_replace({e}, {q(pattern)}, {lit(by)}, 'g')"
        return e

    def unesc(e):
        number = ("case when regexp_matches(x, '^#[0-9]{1,7};') then regexp_extract(x, '^#([0-9]{1,7});', 1)::bigint "
                  "when regexp_matches(x, '^#[xX][0-9a-fA-F]{1,6};') then ('0x' || regexp_extract(x, '^#[xX]([0-9a-fA-F]{1,6});', 1))::bigint else 0 end")
        known = " ".join(f"when x like {q(name + ';%')} then {lit(char)} || substr(x, {len(name) + 2})" for name, char in (
            ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\xa0"), ("amp", "&")))
        piece = (f"case when (({number}) between 1 and 55295) or (({number}) between 57344 and 1114111) "
                 f"then chr(({number})::int) || regexp_replace(x, '^#[0-9a-fA-FxX]+;', '') {known} else '&' || x end")
        parts = f"string_split({e}, '&')"
        return f"({parts}[1] || array_to_string([{piece} for x in {parts}[2:]], ''))"

    def line(e):
        return f"trim(regexp_replace({e}, {q(w + '+')}, ' ', 'g'))"

    def uuid(e):
        return "'urn:uuid:' || " + " || '-' || ".join(f"substr(md5({e}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))

    crlf, nl = lit("\r\n"), "chr(10)"
    return f"""
with r as (select {uuid(f"'response' || {nl} || coalesce(url, '') || {nl} || coalesce(page_id::varchar, '')")} as id, url as target_uri,
    'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: '
    || strlen(coalesce(html, '')) || {crlf} as source_headers, coalesce(html, '') as payload from pages),
f as (select *, 'sha256:' || sha256(payload) as source_digest,
    {replaced(unesc(replaced('payload', strip)), tidy)} as text,
    [{line(unesc('y'))} for y in regexp_extract_all(payload, {q(LINK)}, 1)] as links,
    {line(unesc(f"regexp_replace(regexp_extract(payload, {q(TITLE)}, 1), '<[^>]*>', '', 'g')"))} as title,
    lower(regexp_extract(payload, {q(LANG)}, 1)) as language from r),
b as (select 'metadata' as warc_type, 'application/warc-fields' as content_type, *, 'title: ' || title || {crlf} || 'language: ' || language
    || {crlf} || 'source-status: 200' || {crlf} || 'source-content-type: text/html; charset=utf-8' || {crlf}
    || 'source-payload-digest: ' || source_digest || {crlf} || 'outlinks: ' || len(links) || {crlf}
    || array_to_string(['outlink: ' || z || {crlf} for z in links], '') as block from f
    union all select 'conversion', 'text/plain; charset=utf-8', *, text from f)
select warc_type, {uuid(f"warc_type || {nl} || id")} as record_id, id as refers_to, target_uri, '{DATE}' as warc_date, content_type,
    strlen(block)::bigint as content_length, 'sha256:' || sha256(block) as block_digest, source_digest, source_headers, block from b"""
