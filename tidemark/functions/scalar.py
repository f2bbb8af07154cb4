"""Scalar functions on text, addresses, hashes, JSON values, HTML and vectors, as columns."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, as 16 hex digits.

    The prime is 2^40 + 435, so a product modulo 2^64 is a shift and a small
    product; it is carried as two halves of 32 bits, which never overflow.
    """
    half = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    raw = F.hex(F.encode(text, "UTF-8"))
    count = F.octet_length(text)
    codes = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.conv(F.substring(raw, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    pair = lambda high, low: F.struct(high.cast("bigint").alias("h"), low.cast("bigint").alias("l"))

    def step(s: Column, byte: Column) -> Column:
        low = s["l"].bitwiseXOR(byte)
        product = low * 435
        high = s["h"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return pair(half(high), half(product))

    start = pair(F.lit(FNV_OFFSET >> 32), F.lit(FNV_OFFSET & 0xFFFFFFFF))
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.when(text.isNotNull(), F.aggregate(codes, start, step, lambda s: F.concat(digits(s["h"]), digits(s["l"]))))


#: Fixed value: the reflected polynomial of CRC-64/GO-ISO.
CRC_POLYNOMIAL = 0xD800000000000000


def crc_table() -> list[int]:
    """What each byte adds to a CRC, as unsigned numbers."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (CRC_POLYNOMIAL if value & 1 else 0)
        out.append(value)
    return out


def crc64(data: Column) -> Column:
    """CRC-64/GO-ISO of a binary or a text's UTF-8 bytes, as 16 hex digits."""
    signed = [v - 2**64 if v >= 2**63 else v for v in crc_table()]
    raw = F.hex(data.cast("binary"))
    count = F.octet_length(data)
    codes = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.conv(F.substring(raw, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    step = lambda h, b: F.get(F.lit(signed), h.bitwiseXOR(b).bitwiseAND(F.lit(255)).cast("int")).bitwiseXOR(F.shiftrightunsigned(h, 8))
    done = F.aggregate(codes, F.lit(-1).cast("bigint"), step, lambda h: F.bitwise_not(h))
    return F.when(data.isNotNull(), F.lpad(F.lower(F.hex(done)), 16, "0"))


def blob_reference(text: Column) -> Column:
    """(epoch, digest, error) of a stored value's reference: a bare SHA-256, or v2:e<epoch>:<digest>; error is shape, version, epoch or digest."""
    parts = F.split(text, ":")
    part = lambda i: F.get(parts, F.lit(i))
    bare = F.size(parts) == 1
    digest = F.when(bare, text).otherwise(part(2))
    number = F.regexp_extract(part(1), r"^e([1-9]\d{0,19})$", 1).try_cast("decimal(20,0)")
    number = F.when(number <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), number)
    sound = digest.rlike("^[0-9a-f]{64}$")
    error = F.when(bare, F.when(~sound, "digest")).when(F.size(parts) > 3, "shape").when(part(0) != "v2", "version").when(F.size(parts) < 3, "shape").when(number.isNull(), "epoch").when(~sound, "digest")
    none = error.isNotNull()
    return F.when(text.isNotNull(), F.struct(F.when(~none & ~bare, number).alias("epoch"), F.when(~none, digest).alias("digest"), error.alias("error")))


def table_name(prefix: str, script: str, cls: str, table: str) -> str:
    """PREFIX_SCRIPT_CLASS_TABLE_HASH, parts upper-cased, cleaned and cut to 48 characters, so that distinct sources stay apart."""
    h = FNV_OFFSET
    for b in "\0".join((script, cls, table)).encode():
        h = (h ^ b) * FNV_PRIME & (2**64 - 1)
    clean = ["".join(c if c.isascii() and c.isalnum() else "_" for c in x).upper()[:48] for x in (prefix, script, cls, table)]
    return "_".join(clean) + f"_{h >> 32:08X}"


def traceparent(header: Column) -> Column:
    """(trace_id, span_id, sampled) of a version 00 header; null if it isn't valid."""
    shape = r"^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
    trace, span, flags = (F.regexp_extract(header, shape, i) for i in (1, 2, 3))
    valid = header.rlike(shape) & (trace != "0" * 32) & (span != "0" * 16)
    return F.when(valid, F.struct(trace.alias("trace_id"), span.alias("span_id"), (F.conv(flags, 16, 10).cast("int") % 2 == 1).alias("sampled")))


def _name(pair: Column) -> Column:
    return F.split_part(pair, F.lit("="), F.lit(1))


def _value(pair: Column) -> Column:
    """What follows the first = of a pair, or nothing."""
    return F.when(F.contains(pair, F.lit("=")), F.substring(pair, F.length(_name(pair)) + 2, F.length(pair))).otherwise("")


def query_values(url: Column, name: str) -> Column:
    """All values of a query parameter, in order; names and values are decoded, + is a space."""
    query = F.split(F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit("")), "&")
    return F.transform(F.filter(query, lambda p: F.try_url_decode(_name(p)) == name), lambda p: F.try_url_decode(_value(p)))


def _edited(pairs: Column, what: str, name: str, value: str | None) -> Column:
    own = lambda p: F.coalesce(F.try_url_decode(_name(p)) == name, F.lit(False))
    made = F.concat(F.url_encode(F.lit(name)), F.lit("="), F.url_encode(F.lit(value or "")))
    if what == "append":
        return F.array_append(pairs, made)
    rest = F.filter(pairs, lambda p: ~own(p))
    if what == "delete":
        return rest
    first = F.array_min(F.transform(pairs, lambda p, i: F.when(own(p), i)))
    kept = F.array_compact(F.transform(pairs, lambda p, i: F.when(i == first, made).when(~own(p), p)))
    return F.when(first.isNull(), F.array_append(rest, made)).otherwise(kept)


def edit_query(url: Column, edits: list[tuple[str, str, str | None]]) -> Column:
    """A URL with its query parameters edited in turn: ("set", name, value), ("append", name, value) or ("delete", name, None).

    set replaces the first parameter of its name and drops the others, or adds
    one; names and values are encoded, and parameters that no edit names stay as they are.
    """
    head = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    tail = F.regexp_extract(url, r"(#.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    for what, name, value in edits:
        pairs = _edited(pairs, what, name, value)
    return F.when(url.isNotNull(), F.concat(head, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""), tail))


def attributes(text: Column) -> Column:
    """k=v,k2=v2 as a map, values percent-decoded (+ stays); of equal keys the last wins.

    Blank pairs are passed over. A pair without a name or without = makes the
    whole list invalid: an error, as a list that is cut in silence would pass for another.
    """
    pairs = F.filter(F.split(text, ","), lambda p: F.trim(p) != "")
    sound = F.forall(pairs, lambda p: F.contains(p, F.lit("=")) & (F.trim(_name(p)) != ""))
    entry = lambda p: F.struct(F.trim(_name(p)).alias("k"), F.url_decode(F.replace(F.trim(_value(p)), F.lit("+"), F.lit("%2B"))).alias("v"))
    merged = F.aggregate(F.transform(pairs, entry), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))
    return F.when(text.isNull() | sound, merged).otherwise(F.raise_error(F.concat(F.lit("not a list of attributes: "), text)))


def scope_parts(scope: Column) -> Column:
    """(class, id, reserved) of a cell scope such as Class:id; names that begin with __ are reserved."""
    cls = F.split_part(scope, F.lit(":"), F.lit(1))
    return F.struct(cls.alias("class"), F.when(F.contains(scope, F.lit(":")), F.substring(scope, F.locate(":", scope) + 1, F.length(scope))).alias("id"), cls.startswith("__").alias("reserved"))


def truncate_utf8(text: Column, limit: int = 8192) -> Column:
    """At most ``limit`` bytes, cut between characters."""
    raw = F.encode(text, "UTF-8")
    tail = F.hex(F.substring(raw, limit + 1, 1))
    back = lambda k: F.hex(F.substring(raw, limit - k + 1, 1)).between("80", "BF")
    cut = F.when(~tail.between("80", "BF"), limit).when(~back(1), limit - 1).when(~back(2), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


def tagged_value(json: Column) -> Column:
    """A tagged key-value JSON as text: numbers, dates (as ms), big integers and byte strings by tag, other values as they are."""
    tag = lambda name: F.get_json_object(json, f"$.${name}")
    return F.coalesce(tag("number"), tag("bigint"), tag("date"), tag("bytes"), tag("blob"), F.when(~json.startswith("{"), F.get_json_object(json, "$")), json)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def redirect(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The target of the first rule that fits: * takes any rest, :name one segment; targets use :splat and :name."""
    import re

    out = F.lit(None).cast("string")
    for pattern, target in reversed(rules):
        names: list[str] = []
        shape = "^"
        for part in re.split(r"(\*|:[A-Za-z]\w*)", pattern):
            if part == "*":
                names.append("splat")
                shape += "(.*)"
            elif part.startswith(":"):
                names.append(part[1:])
                shape += "([^/]+)"
            else:
                shape += re.escape(part)
        result = F.lit(target)
        for i, name in enumerate(names, 1):
            result = F.replace(result, F.lit(f":{name}"), F.regexp_extract(path, shape + "$", i))
        out = F.when(path.rlike(shape + "$"), result).otherwise(out)
    return out


def _escaped(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;")


class _Rewriter(HTMLParser):
    """Streams HTML through, applying rules to the tags they select; what no rule touches leaves as it came."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, rules: list[dict]) -> None:
        super().__init__(convert_charrefs=False)
        self.rules, self.out, self.stack, self.muted = rules, [], [], 0

    def _fits(self, rule: dict, tag: str, attrs: dict) -> bool:
        selector = rule["select"]
        if selector.startswith("!"):
            return False
        name, _, cls = selector.partition(".")
        name, _, attr = name.partition("[")
        return (name in ("", "*", tag)) and (not cls or cls in (attrs.get("class") or "").split()) and (not attr or attr.rstrip("]") in attrs)

    def emit(self, text: str) -> None:
        if not self.muted:
            self.out.append(text)

    def _open(self, tag: str, attrs: list, closed: bool) -> None:
        values = dict(reversed(attrs))  # the first of equal names counts
        values = {k: values[k] for k, _ in attrs}
        before, after, first, last = [], [], [], []
        change, drop, unwrap, inner, instead = False, False, False, None, None
        for rule in (r for r in self.rules if self._fits(r, tag, values)):
            do, text = rule["do"], rule.get("value", "")
            if do == "set":
                values[rule["name"]], change = text, True
            elif do == "unset":
                change |= values.pop(rule["name"], self) is not self
            elif do in ("before", "after", "prepend", "append"):
                {"before": before, "after": after, "prepend": first, "append": last}[do].append(text)
            elif do == "replace":
                instead = text
            elif do == "remove":
                drop = True
            elif do == "unwrap":
                unwrap = True
            elif do == "inner":
                inner = text
        void, source = tag in self.VOID, self.get_starttag_text() or f"<{tag}>"
        for text in before:
            self.emit(text)
        if instead is not None:
            self.emit(instead)
            drop = True
        if not drop and not unwrap:
            if change:
                spelled = source[1 : 1 + len(tag)]
                shown = "".join(f" {k}" if v is None else f' {k}="{_escaped(v)}"' for k, v in values.items())
                source = f"<{spelled}{shown}{' /' if closed else ''}>"
            self.emit(source)
        if void or (closed and not first and not last and inner is None):
            for text in reversed(after):
                self.emit(text)
            return
        muted = drop or inner is not None
        if not drop:
            for text in reversed(first):
                self.emit(text)
            if inner is not None:
                self.emit(inner)
        self.muted += muted
        self.stack.append((tag, muted, not (drop or unwrap), [] if drop else last, after))

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs, True)

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _source(self, closer: str) -> str:
        """What stands in the text from here up to ``closer``, or to the end."""
        at = self._place()
        end = self.text.find(closer, at)
        return self.text[at:] if end < 0 else self.text[at : end + len(closer)]

    def handle_endtag(self, tag):
        source = self._source(">")
        if tag not in [x[0] for x in self.stack]:
            self.emit(source)  # closes nothing that is open
            return
        while self.stack:
            own, muted, shown, last, after = self.stack.pop()
            self.muted -= muted
            for text in last:
                self.emit(text)
            if shown and own == tag:
                self.emit(source)
            for text in reversed(after):
                self.emit(text)
            if own == tag:
                break

    def _other(self, kind: str, text: str) -> None:
        for rule in (r for r in self.rules if r["select"] == kind):
            if rule["do"] == "remove":
                return
            if rule["do"] == "replace":
                text = rule["value"]
        self.emit(text)

    def _reference(self, text: str) -> None:
        self.emit(text + (";" if self.text.startswith(";", self._place() + len(text)) else ""))  # it may stand without

    def handle_data(self, data):
        self.emit(data)

    def handle_entityref(self, name):
        self._reference(f"&{name}")

    def handle_charref(self, name):
        self._reference(f"&#{name}")

    def handle_comment(self, data):
        at = self._place()
        proper = self.text.startswith("<!--", at)
        self._other("!comment", self.text[at : at + 4] + data + self._closed(at + 4 + len(data)) if proper else self._source(">"))

    def _closed(self, at: int) -> str:
        return next((x for x in ("-->", "--!>", ">") if self.text.startswith(x, at)), "")

    def handle_decl(self, decl):
        self._other("!doctype", self._source(">"))

    def handle_pi(self, data):
        self.emit(self._source(">"))

    def unknown_decl(self, data):
        at = self._place()
        rest = self.text[at + 3 + len(data) :]
        self.emit(self.text[at : at + 3 + len(data)] + next((x for x in ("]]>", "]>", ">") if rest.startswith(x)), ""))

    def run(self, text: str) -> str:
        self.text, self.lines = text, [0]
        for at, c in enumerate(text):
            if c == "\n":
                self.lines.append(at + 1)
        self.feed(text)
        self.close()
        return self.finish()

    def finish(self) -> str:
        for rule in (r for r in self.rules if r["select"] == "!end"):
            self.emit(rule["value"])
        return "".join(self.out)


def rewrite_html(html: Column, rules: list[dict]) -> Column:
    """HTML with rules applied; tags, text and references that no rule touches leave as they came.

    A rule: {"select", "do", "value", "name"}. It selects a tag, .class,
    tag[attr], !comment, !doctype or !end. It may set or unset an attribute, put
    text before, after, prepend or append it, replace, remove, unwrap, or replace what is inner.
    """

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda text: None if text is None else _Rewriter(rules).run(text))

    return run(html)
