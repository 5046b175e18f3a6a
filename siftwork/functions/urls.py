"""URL expressions: one grammar, and the separate canonical forms that the operators need.

Forms differ on purpose: a dataset value keeps its query and host name, a match key drops scheme
and ``www.``, a source's canonical form drops tracking and secret parameters and sorts the rest.
Paths and queries are percent-encoded and paths lose their dot segments, as URL parsers do it.
Hosts beyond ASCII are for ``with_ascii_host``, which the others don't call, as it needs Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

GRAMMAR = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\s\[\]]+)(?::(\d*))?((?:/[^?#]*)?)(\?[^#]*)?(#.*)?$"
#: Parameters that only track, and those that may hold secrets.
TRACKING_NAMES, SECRET_NAMES = "utm_.+|gclid|fbclid|mc_cid|mc_eid", "token|access_token|api_key|apikey|key|session|sessionid|auth"
TRACKING, SECRET, TRACKING_OR_SECRET = (rf"(?i)^({names})$" for names in (TRACKING_NAMES, SECRET_NAMES, f"{TRACKING_NAMES}|{SECRET_NAMES}"))
#: Host names that are never public.
LOCAL_SUFFIXES = ("localhost", "local", "internal", "corp", "lan", "home", "intranet", "localdomain")
METADATA_HOSTS = ("localhost", "metadata.google", "metadata", "instance-data")
#: IPv4 ranges that aren't public, as first and last address.
RESERVED_IPV4 = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    ("192.88.99.0", "192.88.99.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
)
#: IPv6 text prefixes that aren't public.
RESERVED_IPV6 = r"^(fc|fd|fe[89abcdef]|ff|100:|2001:db8:|2001:0db8:|2002:)"


@dataclass(frozen=True)
class Parts:
    """Columns of a URL's parts; all are empty if it isn't one."""

    scheme: Column
    user: Column
    host: Column
    port: Column
    path: Column
    query: Column
    is_url: Column

    @property
    def is_http(self) -> Column:
        return self.is_url & self.scheme.isin("http", "https")

    @property
    def authority(self) -> Column:
        return F.concat(self.host, F.when(self.port == "", "").otherwise(F.concat(F.lit(":"), self.port)))


NUL = "\x00"
#: An http(s) URL without credentials, as ``with_parts`` would find it.
WEB = r"^(?![^#]*\x00)" + GRAMMAR[1:].replace("([A-Za-z][A-Za-z0-9+.-]*)", "[Hh][Tt][Tt][Pp][Ss]?", 1).replace("([^/?#@]*)@", "@", 1)


def _split(c: Column) -> Column:
    """The groups of the grammar in one match, or the text alone if it doesn't match."""
    groups = NUL.join(f"${k}" for k in range(1, 7))
    return F.split(F.regexp_replace(c, GRAMMAR, groups), NUL)


#: Characters that are percent-encoded in paths and in queries, and segments that stand for this and the upper level.
UNSAFE_PATH = r"[^\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E\x25]"
UNSAFE_QUERY = r"[^\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E\x25]"
THIS_LEVEL, UPPER_LEVEL = r"(?i)^(?:\.|%2e)$", r"(?i)^(?:\.|%2e){2}$"
DOTS = r"(?i)/(?:\.|%2e){1,2}(?:/|$)"


def _encoded(c: Column, unsafe: str) -> Column:
    """``c`` with the UTF-8 bytes of unsafe characters in hex; other texts aren't taken apart."""
    one = lambda x: F.when(x.rlike(unsafe), F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", r"%$1")).otherwise(x)
    return F.when(c.rlike(unsafe), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def _without_dots(path: Column) -> Column:
    """A path without segments of one or two dots, which mean the same and the upper level; at the end they leave a slash."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda acc, x: F.when(x.rlike(UPPER_LEVEL), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x.rlike(THIS_LEVEL), acc).otherwise(F.concat(acc, F.array(x))),
    )
    last = F.element_at(parts, -1)
    made = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when((last.rlike(UPPER_LEVEL) | last.rlike(THIS_LEVEL)) & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path.rlike(DOTS), made).otherwise(path)


def _once(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` evaluated once, however often ``body`` uses it."""
    return F.transform(F.array(c), body)[0]


def _parts(a: Column) -> Parts:
    get = lambda k: F.when(F.size(a) == 6, F.get(a, F.lit(k - 1))).otherwise("")
    # most paths and queries are taken as they stand; one test tells the others
    odd = lambda c, test, body: _once(c, lambda x: F.when(x.rlike(test), body(x)).otherwise(x))
    path = odd(get(5), f"{UNSAFE_PATH}|{DOTS}", lambda x: _once(_without_dots(x), lambda y: _encoded(y, UNSAFE_PATH)))
    scheme, port, query = F.lower(get(1)), get(4), odd(get(6), UNSAFE_QUERY, lambda x: _encoded(x, UNSAFE_QUERY))
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return Parts(scheme, get(2), F.lower(get(3)), F.when(default, "").otherwise(port), _once(path, lambda x: F.when(x == "", "/").otherwise(x)), _once(query, lambda x: F.when(x == "?", "").otherwise(x)), F.coalesce(F.size(a) == 6, F.lit(False)))


def parts(c: Column) -> Parts:
    """Parts as columns; where more than a few are used, ``with_parts`` matches only once."""
    return _parts(_split(c))


def with_parts(c: Column, body: Callable[[Parts], Column]) -> Column:
    """``body`` of a URL's parts. Each part is made once for a row; ``body`` refers to fields, however often it uses them."""
    names = [f.name for f in fields(Parts)]
    made = F.transform(F.array(_split(c)), lambda a: F.struct(*[getattr(p, n).alias(n) for p in [_parts(a)] for n in names]))
    return F.transform(made, lambda s: body(Parts(*[s[n] for n in names])))[0]


#: Fixed value: the prefix of a label that stands for characters beyond ASCII.
ENCODED_LABEL = "xn--"
#: An authority with a character beyond ASCII behind a scheme.
WIDE_HOST = r"^([A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?)([^/?#:@]*[^\x00-\x7F/?#:@][^/?#:@]*)"


def ascii_label(label: str) -> str:
    """A host's label in ASCII: compatibility form in lower case, in bootstring code if it still has wider characters."""
    plain = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", label).lower())
    return plain if plain.isascii() else ENCODED_LABEL + plain.encode("punycode").decode("ascii")


@F.pandas_udf(StringType())
def _ascii_host(hosts: pd.Series) -> pd.Series:
    dots = re.compile("[.\u3002\uff0e\uff61]")
    return hosts.map(lambda h: None if h is None else ".".join(map(ascii_label, dots.split(h))))


def with_ascii_host(c: Column) -> Column:
    """A URL whose host is in ASCII, as the other forms expect it. Only hosts with wider characters leave the JVM, in Arrow batches."""
    wide = c.rlike(WIDE_HOST)
    made = _ascii_host(F.when(wide, F.regexp_extract(c, WIDE_HOST, 2)))
    return F.when(wide, F.concat(F.regexp_extract(c, WIDE_HOST, 1), made, F.regexp_replace(c, WIDE_HOST, ""))).otherwise(c)


def _no_slashes(path: Column) -> Column:
    return F.rtrim(path, F.lit("/"))


def with_scheme(c: Column, slashes: bool = True) -> Column:
    """https is assumed where there is no scheme."""
    return F.when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:" + "//" * slashes), c).otherwise(F.concat(F.lit("https://"), c))


def dataset_form(c: Column) -> Column:
    """A URL value: lower-case host, no fragment, no trailing slashes; null if it isn't an http(s) URL."""

    def form(p: Parts) -> Column:
        path = F.when(p.path == "/", "/").otherwise(F.when(_no_slashes(p.path) == "", "/").otherwise(_no_slashes(p.path)))
        user = F.when(p.user == "", "").otherwise(F.concat(p.user, F.lit("@")))
        return F.when(p.is_http, F.concat(p.scheme, F.lit("://"), user, p.authority, path, p.query))

    return with_parts(with_scheme(c, slashes=False), form)


def match_key(c: Column) -> Column:
    """Host without ``www.``, path and query in lower case: equal for one page under two schemes."""

    def form(p: Parts) -> Column:
        return F.when(p.is_http, F.lower(F.concat(F.regexp_replace(p.host, r"^www\.", ""), _no_slashes(p.path), p.query)))

    return with_parts(with_scheme(c), form)


def parameters(query: Column, drop: str) -> Column:
    """The query (with its question mark) without parameters named ``drop``, sorted by name; empty if none is left."""
    pairs = F.filter(F.split(F.substring(query, 2, 1 << 30), "&"), lambda x: (x != "") & ~F.substring_index(x, "=", 1).rlike(drop))
    keyed = F.transform(pairs, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("k"), i.alias("i"), x.alias("x")))
    joined = F.array_join(F.transform(F.sort_array(keyed), lambda s: s["x"]), "&")
    return F.when((query == "") | (joined == ""), "").otherwise(F.concat(F.lit("?"), joined))


def source_of(p: Parts, hidden: Column) -> Column:
    """Canonical URL of a source's parts; null if its scheme or credentials rule it out, or ``hidden``, that its host isn't public."""
    host = F.regexp_replace(p.host, r"\.$", "")
    authority = F.concat(host, F.when(p.port == "", "").otherwise(F.concat(F.lit(":"), p.port)))
    path = F.when(F.length(p.path) > 1, _no_slashes(p.path)).otherwise(p.path)
    made = F.concat(p.scheme, F.lit("://"), authority, F.when(path == "", "/").otherwise(path), parameters(p.query, TRACKING_OR_SECRET))
    return F.when(p.is_http & (p.user == "") & ~hidden, made)


def source_form(c: Column) -> Column:
    """Canonical URL of a source; null if its scheme, credentials or host rule it out."""
    return with_parts(c, lambda p: source_of(p, non_public_host(p.host)))


def ranking_form(c: Column) -> Column:
    """URL under which candidates of one page meet: also without ``www.``, and secrets stay."""

    def form(p: Parts) -> Column:
        path = F.when(_no_slashes(p.path) == "", "/").otherwise(_no_slashes(p.path))
        return F.when(p.is_http & (p.user == ""), F.concat(p.scheme, F.lit("://"), F.regexp_replace(p.authority, r"^www\.", ""), path, parameters(p.query, TRACKING)))

    return with_parts(c, form)


def evidence_form(c: Column) -> Column:
    """URL as evidence is compared: lower-case host, no fragment, without the last slash."""

    def form(p: Parts) -> Column:
        user = F.when(p.user == "", "").otherwise(F.concat(p.user, F.lit("@")))
        return F.when(p.is_url, F.regexp_replace(F.concat(p.scheme, F.lit("://"), user, p.authority, p.path, p.query), "/$", ""))

    return with_parts(c, form)


def safe_of(p: Parts) -> Column:
    """A URL's parts for logs: no credentials, fragment or secret parameters, cut at 2,000 characters."""
    pairs = F.filter(F.split(F.substring(p.query, 2, 1 << 30), "&"), lambda x: (x != "") & ~F.substring_index(x, "=", 1).rlike(SECRET))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(p.is_url, F.substring(F.concat(p.scheme, F.lit("://"), p.authority, p.path, query), 1, 2000)).otherwise("[invalid-source-url]")


def safe_form(c: Column) -> Column:
    """URL for logs: no credentials, fragment or secret parameters, cut at 2,000 characters."""
    return with_parts(c, safe_of)


def host(c: Column) -> Column:
    """Lower-case host; null if the text isn't a URL."""

    def form(p: Parts) -> Column:
        return F.when(p.is_url, p.host)

    return with_parts(c, form)


def bare_host(c: Column) -> Column:
    """Host without ``www.``."""
    return F.regexp_replace(host(c), r"^www\.", "")


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return a << 24 | b << 16 | c << 8 | d


IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def non_public_ipv4(ip: Column) -> Column:
    """Whether a dotted address lies in a range that isn't public, or isn't an address."""
    octets = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("bigint"))
    # the address as one number, -1 if an octet is too large
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, x: F.when((a < 0) | (x > 255), -1).otherwise(a * 256 + x))
    reserved = lambda v: F.exists(F.array(*[F.struct(F.lit(_number(a)).cast("bigint").alias("a"), F.lit(_number(b)).cast("bigint").alias("b")) for a, b in RESERVED_IPV4]), lambda r: v.between(r["a"], r["b"])) | (v < 0)
    judged = F.transform(F.array(value), reserved)[0]
    return F.when(~ip.rlike(IPV4), True).otherwise(F.coalesce(judged, F.lit(True)))


def non_public_ipv6(ip: Column) -> Column:
    """Whether an address without brackets has a prefix that isn't public; embedded IPv4 addresses are judged as such."""
    inner = F.regexp_extract(ip, r"^::(?:ffff:(?:0:)?)?(\d+\.\d+\.\d+\.\d+)$", 1)
    fixed = ip.isin("::", "::1", "0:0:0:0:0:0:0:0", "0:0:0:0:0:0:0:1")
    return F.when(fixed, True).when(inner != "", non_public_ipv4(inner)).otherwise(ip.rlike(RESERVED_IPV6))


def non_public_host(h: Column) -> Column:
    """Whether a host is local, private or reserved: by address class, missing dot, suffix or name."""
    name = F.regexp_replace(F.lower(h), r"\.$", "")
    bare = F.regexp_replace(name, r"^\[|\]$", "")
    suffix = name.rlike(r"\.(" + "|".join(LOCAL_SUFFIXES) + r")$")
    named = ~name.contains(".") | suffix | name.isin(*METADATA_HOSTS)
    return F.when(name.isNull() | (name == ""), True).when(bare.contains(":"), non_public_ipv6(bare)).when(name.rlike(IPV4), non_public_ipv4(name)).otherwise(named)


def rule_host(rule: str) -> str:
    """The host a domain rule is about; a leading ``*.`` means the same as none."""
    text = rule.strip().lower().removeprefix("https://").removeprefix("http://")
    for c in "/:?#":
        text = text.split(c, 1)[0]
    return text.removesuffix(".").removeprefix("*.")


def matches_rules(h: Column, rules: list[str] | tuple[str, ...]) -> Column:
    """Whether a host is one of the rules' hosts or below one."""
    out = F.lit(False)
    for r in map(rule_host, rules):
        out = out | (h == r) | h.endswith(f".{r}")
    return out
