"""Column expressions over names, paths, messages and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"
# fixed values: attribute keys of a route, in the order they are looked at
PATH_KEYS = ["http.route", "url.path", "url.full", "http.url", "http.target"]
MAX_TOKENS = 64


def filled(value: Column) -> Column:
    return F.when(value != "", value)


def normalize_path(raw: Column) -> Column:
    """Path without query, fragment, scheme and host; segments with a digit or over 24 bytes become <*>."""
    plain = F.regexp_replace(raw, r"[?#][\s\S]*$", "")
    path = F.regexp_replace(plain, r"^[\s\S]*?://[^/]*", "")
    segments = F.transform(F.split(path, "/"), lambda s: F.when((F.octet_length(s) > 24) | s.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(s))
    return F.coalesce(filled(F.array_join(segments, "/")), F.lit("/"))


def endpoint_name(name: Column, attrs: Column) -> Column:
    """The span's name, with its route if the name alone has no path."""
    raw = F.coalesce(*(filled(attrs[k]) for k in PATH_KEYS))
    return F.when(F.instr(name, "/") > 0, name).otherwise(F.coalesce(F.concat_ws(" ", name, F.when(raw.isNotNull(), normalize_path(raw))), name))


def url_host(url: Column) -> Column:
    """Host of a URL without user and port; null if there is none."""
    authority = F.regexp_extract(url, r"^.*?://([^/?#]*)", 1)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    host = F.when(host_port.startswith("["), F.regexp_extract(host_port, r"^(\[[^\]]*\]?)", 1)).otherwise(F.regexp_extract(host_port, r"^([^:]*)", 1))
    return F.when(url.contains("://"), filled(host))


def peer_of(attrs: Column) -> Column:
    method = attrs["rpc.method"]
    service = F.when(F.instr(method, "/") > 0, F.regexp_extract(method, r"^([\s\S]*)/[^/]*$", 1))
    host = url_host(F.coalesce(attrs["url.full"], attrs["http.url"]))
    return F.coalesce(attrs["peer.service"], attrs["rpc.service"], service, attrs["server.address"], host, F.lit("an unknown peer"))


def operation_of(name: Column, attrs: Column) -> Column:
    return F.coalesce(attrs["rpc.method"], attrs["http.route"], name)


def mask(text: Column) -> Column:
    """UUIDs, hex runs of eight and more, then numbers become <*>; digits and word ends as in Unicode."""
    # fixed patterns, in the order they apply
    for pattern in (r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", r"(?U)\b(?:0x)?[0-9a-fA-F]{8,}\b", r"(?U)\d+(?:\.\d+)?"):
        text = F.regexp_replace(text, pattern, WILDCARD)
    return text


def short_hash(*parts: Column) -> Column:
    """16 hex digits over the parts, each ended by a NUL."""
    ended = [x for p in parts for x in (p.cast("string"), F.lit("\0"))]
    return F.substring(F.md5(F.concat(*ended)), 1, 16)


def log_id(trace_id: Column, span_id: Column, ts_ns: Column, body: Column) -> Column:
    return short_hash(trace_id, span_id, ts_ns, body)


def log_tokens(body: Column, keep_http_status: bool = True) -> Column:
    """Masked tokens of a log line; an HTTP status right after the protocol stays as it is."""
    raw = F.filter(F.split(body, r"[ \t\n\f\r]+"), lambda t: t != "")

    def masked(tokens: Column) -> Column:
        def one(token: Column, i: Column) -> Column:
            hidden = mask(token)
            out = F.when(hidden.contains(WILDCARD), F.lit(WILDCARD)).otherwise(hidden)
            if not keep_http_status:
                return out
            before = F.when(i > 0, F.element_at(tokens, i))
            return F.when(token.rlike("^[1-5][0-9]{2}$") & F.coalesce(before.rlike(r'HTTP/[0-9](\.[0-9])?"?$'), F.lit(False)), token).otherwise(out)

        return F.transform(tokens, one)

    tokens = F.element_at(F.transform(F.array(raw), masked), 1)
    cut = F.when(F.size(raw) > MAX_TOKENS, F.concat(F.slice(tokens, 1, MAX_TOKENS), F.array(F.lit("<…>")))).otherwise(tokens)
    return F.when(F.size(raw) == 0, F.array(F.lit("<empty>"))).otherwise(cut)


def redact_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)https?://[^\s\"'<>)]*", "<redacted>")


def truncate_utf8(text: Column, most: int) -> Column:
    """The longest prefix of at most so many bytes that ends at a character."""
    cut = F.substring(text.cast("binary"), 1, most)
    whole = F.regexp_replace(cut.cast("string"), "�+$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(whole)


def severity_label(text: Column, number: Column) -> Column:
    """The text of a severity, else the name of its range of numbers."""
    names = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"]  # fixed values
    ranged = F.element_at(F.array(*(F.lit(n) for n in names)), (F.floor((number - 1) / 4) + 1).cast("int"))
    return F.coalesce(filled(F.upper(text)), F.when(number.between(1, 24), ranged), F.lit("UNSET"))
