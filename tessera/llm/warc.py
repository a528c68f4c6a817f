"""WARC derivatives: metadata and plain-text conversion records of responses.

For each response record two records are built that refer to it: ``metadata`` keeps its HTTP headers,
its digests, its title and its links; ``conversion`` holds the text of its page. Both are also given as
the bytes of a WARC/1.1 record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.secrets import either_case

DATE = "2024-01-01T00:00:00Z"
_SILENT = "|".join(f"{either_case(t)}[^>]*>.*?</{either_case(t)}[^>]*>" for t in ("script", "style", "noscript", "template"))
_BLOCK = "</?(" + "|".join(map(either_case, "address article aside blockquote body br dd div dl dt fieldset figure footer form head header hr html li main nav ol p pre section table td th title tr ul".split())) + r"|[Hh][1-6])([ /\n\t][^>]*)?>"
#: (pattern, replacement), applied in this order: what isn't shown, breaks, other tags.
TAGS = ((f"<(?s:!--.*?-->|{_SILENT})", ""), (_BLOCK, "\n"), ("<[^>]*>", ""))
# Character references and what they stand for; the ampersand's own comes last.
REFERENCES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: Runs of white space that aren't one space, then breaks with white space around them.
SPACES = ((r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " "), (r" \n[ \n]*|\n[ \n]+", "\n"))
TITLE = f"(?s:<{either_case('title')}[^>]*>(.*?)</{either_case('title')})"
LINK = rf"""[ \t\r\n"'/]{either_case("href")}[ \t\r\n]*=[ \t\r\n]*("[^"]*"|'[^']*'|[^ \t\r\n"'>]+)"""


def page_text(html: Column) -> Column:
    for pattern, put in TAGS:
        html = F.regexp_replace(html, pattern, put)
    plain = html
    for name, put in REFERENCES:
        plain = F.replace(plain, F.lit(name), F.lit(put))
    for pattern, put in SPACES:
        plain = F.regexp_replace(plain, pattern, put)
    return F.btrim(plain, F.lit(" \n"))


def unquoted(link: Column) -> Column:
    quoted = link.startswith('"') | link.startswith("'")
    return F.when(quoted, link.substr(F.lit(2), F.length(link) - 2)).otherwise(link)


def urn(*parts: Column) -> Column:
    h = F.md5(F.encode(F.concat_ws("|", *parts), "utf-8"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "utf-8"), 256))


def derivatives(spark: SparkSession, responses: DataFrame) -> DataFrame:
    """Two rows a response: ``record_id, warc_type, refers_to, target_uri, warc_date, content_type,
    content_length, block_digest, source_digest, block, record``.

    ``responses`` has ``record_id, target_uri, warc_date, http_headers, body``, texts. A null record id,
    target or date is written as an empty value, null headers or a null body count as empty; rows that
    repeat give repeated records. Other columns are not read. ``record`` is the record as text, to be
    written in UTF-8; its lengths are in bytes.
    """
    names = ("record_id", "target_uri", "warc_date", "http_headers", "body")
    r = responses.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names))
    r = r.withColumn("source_digest", digest(F.col("body")))
    title = F.regexp_replace(F.regexp_extract("body", TITLE, 1), r"[ \t\r\n]+", " ")
    links = F.array_join(F.transform(F.regexp_extract_all("body", F.lit(LINK), F.lit(1)), lambda u: F.concat(F.lit("outlink: "), F.regexp_replace(unquoted(u), r"[\r\n]+", ""), F.lit("\r\n"))), "")
    about = F.concat(F.lit("source-digest: "), "source_digest", F.lit("\r\n"), F.regexp_replace("http_headers", r"(?m)^(?=[^\r\n])", "source-header-"), F.lit("title: "), title, F.lit("\r\n"), links)
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), about.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), page_text(F.col("body")).alias("block")),
    )
    r = r.select("*", F.explode(kinds).alias("k")).select("*", "k.*").withColumn("refers_to", F.col("record_id"))
    r = r.withColumn("record_id", urn(F.col("warc_type"), F.col("refers_to"), F.col("target_uri"), F.col("warc_date")))
    r = r.withColumn("block_digest", digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    heads = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    angled = {"record_id", "refers_to"}
    lines = [F.concat(F.lit(f"{n}: " + "<" * (c in angled)), F.col(c).cast("string"), F.lit(">" * (c in angled) + "\r\n")) for n, c in heads]
    record = F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), "block", F.lit("\r\n\r\n"))
    return r.select("record_id", "warc_type", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_digest", "block", record.alias("record"))


def page_responses(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as response records."""
    headers = "Content-Type: text/html; charset=utf-8\r\n"
    return pages.select(urn(F.lit("response"), F.col("page_id").cast("string"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(DATE).alias("warc_date"), F.lit(headers).alias("http_headers"), F.col("html").alias("body"))


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in ``data``; the reader that the builder's round trip is held against."""
    out, at = [], 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        begin = stop + 4
        size = int(head["Content-Length"])
        if data[begin + size : begin + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end after its length")
        out.append((head, data[begin : begin + size]))
        at = begin + size + 4
    return out


def derivatives_sql() -> str:
    """Digests of the derivatives of ``pages`` as DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    crlf = "chr(13) || chr(10)"
    put = lambda x: q(x) if x != chr(10) else "chr(10)"
    text = "body"
    for pattern, by in TAGS:
        text = f"regexp_replace({text}, {q(pattern)}, {put(by)}, 'g')"
    for name, by in REFERENCES:
        text = f"replace({text}, {q(name)}, {q(by)})"
    for pattern, by in SPACES:
        text = f"regexp_replace({text}, {q(pattern)}, {put(by)}, 'g')"
    text = f"trim({text}, ' ' || chr(10))"

    def urn_sql(*parts: str) -> str:
        h = f"md5(concat_ws('|', {', '.join(parts)}))"
        return "'urn:uuid:' || " + " || '-' || ".join(f"substring({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))

    title = f"regexp_replace(regexp_extract(body, {q(TITLE)}, 1), '[ \\t\\r\\n]+', ' ', 'g')"
    links = f"coalesce(list_aggregate(list_transform(regexp_extract_all(body, {q(LINK)}, 1), lambda u: 'outlink: ' || regexp_replace(CASE WHEN u[1] IN (chr(34), chr(39)) THEN substring(u, 2, length(u) - 2) ELSE u END, '[\\r\\n]+', '', 'g') || {crlf}), 'string_agg', ''), '')"
    about = f"'source-digest: ' || source_digest || {crlf} || 'source-header-Content-Type: text/html; charset=utf-8' || {crlf} || 'title: ' || {title} || {crlf} || {links}"
    heads = f"""'WARC/1.1' || {crlf} || 'WARC-Type: ' || warc_type || {crlf} || 'WARC-Record-ID: <' || record_id || '>' || {crlf} || 'WARC-Refers-To: <' || refers_to || '>' || {crlf}
        || 'WARC-Target-URI: ' || target_uri || {crlf} || 'WARC-Date: {DATE}' || {crlf} || 'WARC-Block-Digest: ' || block_digest || {crlf} || 'WARC-Source-Digest: ' || source_digest || {crlf}
        || 'Content-Type: ' || content_type || {crlf} || 'Content-Length: ' || content_length || {crlf} || {crlf} || block || {crlf} || {crlf}"""
    return f"""
    WITH r AS (SELECT coalesce({urn_sql("'response'", "CAST(page_id AS VARCHAR)", "url")}, '') AS refers_to, coalesce(url, '') AS target_uri, coalesce(html, '') AS body, 'sha256:' || sha256(coalesce(html, '')) AS source_digest FROM pages),
    k AS (SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, {about} AS block FROM r
          UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {text} FROM r),
    d AS (SELECT *, {urn_sql("warc_type", "refers_to", "target_uri", f"'{DATE}'")} AS record_id, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM k)
    SELECT record_id, warc_type, refers_to, target_uri, content_type, content_length, block_digest, source_digest, sha256({heads}) AS record_sha256 FROM d
    """
