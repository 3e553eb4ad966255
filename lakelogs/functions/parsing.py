"""Parsing of log text as column expressions: access-log lines, logfmt, JSON bodies, bracketed lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of an access-log line, in order.
ALB_FIELDS = (
    "type", "time", "elb", "client", "target", "request_processing_time", "target_processing_time", "response_processing_time",
    "elb_status_code", "target_status_code", "received_bytes", "sent_bytes", "request", "user_agent", "ssl_cipher", "ssl_protocol",
    "target_group_arn", "trace_id", "domain_name", "chosen_cert_arn", "matched_rule_priority", "request_creation_time",
    "actions_executed", "redirect_url", "error_reason",
)
MIN_FIELDS = 12
_TOKEN = r'"((?:[^"\\]|\\.)*)"|(\S+)'


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def or_null(col: Column) -> Column:
    """``-`` and the empty text are no value."""
    return F.when(~col.isin("-", ""), col)


def endpoint(col: Column) -> tuple[Column, Column]:
    """``ip:port`` or ``[v6]:port`` -> (ip, port)."""
    v6 = col.startswith("[")
    last = F.substring_index(col, ":", -1)
    ip = F.when(v6, F.regexp_extract(col, r"^\[(.*)\]", 1)).when(col.contains(":"), F.substring(col, F.lit(1), F.length(col) - F.length(last) - 1)).otherwise(col)
    port = F.when(v6, F.regexp_extract(col, r"\]:(\d+)$", 1)).when(col.contains(":") & last.rlike(r"^\d+$"), last)
    return F.when(or_null(col).isNotNull(), or_null(ip)), F.when(or_null(col).isNotNull(), port.try_cast("int"))


def whole(col: Column, kind: str = "int") -> Column:
    return or_null(col).try_cast(kind)


def seconds(col: Column) -> Column:
    """A duration; below zero means that there is none."""
    value = or_null(col).try_cast("double")
    return F.when(value >= 0, value)


def iso_time(col: Column) -> Column:
    """ISO-8601 text to a zone-less UTC timestamp, else null."""
    return F.try_to_timestamp(or_null(col)).cast("timestamp_ntz")


def request_parts(col: Column) -> tuple[Column, Column, Column, Column]:
    """``METHOD url PROTOCOL`` -> (method, url, protocol, path); one word alone is none of them."""
    part = F.split(col, " ", 3)
    some = F.size(part) >= 2
    url = F.when(some, or_null(F.get(part, 1)))
    return F.when(some, or_null(F.get(part, 0))), url, F.when(some, or_null(F.get(part, 2))), url_path(url)


def url_path(url: Column) -> Column:
    """The path of a URL; the URL itself if it has none; what is before ``?`` if it can't be parsed."""
    parsed = F.try_parse_url(url, F.lit("PATH"))
    return F.when(parsed == "", url).otherwise(F.coalesce(parsed, F.substring_index(url, "?", 1)))


def tokens(line: Column) -> Column:
    """Blank-separated tokens; double quotes hold one token together, a backslash in them keeps the next character."""
    raw = F.regexp_extract_all(line, F.lit(r'"[^"\\]*(?:\\.[^"\\]*)*"|\S+'), F.lit(0))
    inner = lambda t: F.substring(t, F.lit(2), F.length(t) - 2)
    return F.transform(raw, lambda t: F.when(~t.startswith('"'), t).when(t.contains("\\"), F.regexp_replace(inner(t), r"\\(.)", "$1")).otherwise(inner(t)))


def alb_fields(line: Column) -> Column:
    """Tokens of an access-log line, null for lines that are skipped: comments, blank, short, with an open quote."""
    text = F.trim(line)
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))  # without escaped backslashes and quotes
    quotes = once(plain, lambda p: F.length(p) - F.length(F.replace(p, F.lit('"'), F.lit(""))))
    good = (text != "") & ~text.startswith("#") & (quotes % 2 == 0)
    return F.when(good, once(tokens(text), lambda token: F.when(F.size(token) >= MIN_FIELDS, token)))


def alb_columns(field: Column) -> dict[str, Column]:
    """The typed columns of a tokenised line; fields that are missing at the end are null."""
    at = lambda name: F.get(field, ALB_FIELDS.index(name))
    client_ip, client_port = endpoint(at("client"))
    target_ip, target_port = endpoint(at("target"))
    method, url, protocol, path = request_parts(at("request"))
    text = lambda *names: {n: or_null(at(n)) for n in names}
    return {
        "time": iso_time(at("time")), **text("type", "elb"), "client_ip": client_ip, "client_port": client_port, "target_ip": target_ip, "target_port": target_port,
        **{n: seconds(at(n)) for n in ("request_processing_time", "target_processing_time", "response_processing_time")},
        **{n: whole(at(n)) for n in ("elb_status_code", "target_status_code")}, **{n: whole(at(n), "bigint") for n in ("received_bytes", "sent_bytes")},
        "request_method": method, "request_url": url, "request_path": path, "request_protocol": protocol,
        **text("user_agent", "ssl_cipher", "ssl_protocol", "domain_name", "actions_executed", "redirect_url", "error_reason", "trace_id"),
    }


def _unescaped(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def logfmt_pairs(line: Column) -> Column:
    """``k="v"`` pairs as a map (the last of equal keys counts), null if there are fewer than two."""
    pair = r'(\w+)="((?:[^"\\]|\\.)*)"'
    keys, values = (F.regexp_extract_all(line, F.lit(pair), F.lit(i)) for i in (1, 2))
    entries = F.arrays_zip(keys.alias("key"), F.transform(values, _unescaped).alias("value"))

    def last_of_equals(found: Column) -> Column:
        names = F.transform(found, lambda e: e["key"])
        return F.map_from_entries(F.filter(found, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"])))

    return once(F.when(F.size(keys) >= 2, entries), lambda found: F.when(found.isNotNull(), last_of_equals(found)))


def logfmt_message(line: Column) -> Column:
    """message, log, msg or line of a logfmt line; the line itself if it isn't one, or has none of them."""
    return F.coalesce(once(logfmt_pairs(line), lambda m: F.coalesce(*[F.nullif(m[k], F.lit("")) for k in ("message", "log", "msg", "line")])), line)


def logfmt_labels(line: Column) -> Column:
    """The other pairs of a logfmt line, without its times."""
    return F.map_filter(logfmt_pairs(line), lambda k, v: ~k.isin("message", "log", "msg", "line", "time", "timestamp"))


_BODY = "app string, env string, service string, namespace string, pod string, container string, level string, kubernetes struct<pod_name:string,container_name:string,namespace:string,labels:map<string,string>>"


def json_labels(body: Column) -> Column:
    """Labels that a JSON body carries; the cluster's values and labels win over the top level. Null if it isn't JSON."""
    return once(F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, _BODY)), _labels_of)


def _labels_of(parsed: Column) -> Column:
    named = {c: parsed[c] for c in ("app", "env", "service", "namespace", "pod", "container", "level")}
    k8s = parsed["kubernetes"]
    named |= {c: F.coalesce(F.nullif(k8s[f], F.lit("")), named[c]) for c, f in (("pod", "pod_name"), ("container", "container_name"), ("namespace", "namespace"))}
    top = F.array(*[F.struct(F.lit(c).alias("key"), v.alias("value")) for c, v in named.items()])
    extra = F.transform(F.map_entries(F.coalesce(k8s["labels"], F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.regexp_replace(e["key"], r"[-. ]", "_").alias("key"), e["value"].alias("value")))

    def merged(more: Column) -> Column:
        keys = F.transform(more, lambda m: m["key"])
        own = F.filter(top, lambda e: (F.coalesce(e["value"], F.lit("")) != "") & ~F.array_contains(keys, e["key"]))
        last = F.filter(more, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))  # of names that became equal
        return F.map_from_entries(F.concat(own, last))

    return F.when(parsed.isNotNull(), once(extra, merged))


def bracketed(line: Column) -> dict[str, Column]:
    """``[time] LEVEL message``."""
    pattern = r"^\[([^\]]+)\]\s+(\w+)\s+(.*)$"
    hit = line.rlike(pattern)
    return {n: F.when(hit, F.regexp_extract(line, pattern, i)) for i, n in enumerate(("time", "level", "message"), 1)}
