"""Secret scans with multipart credential linking, in column expressions only.

Base findings are assignments, access identifiers and long hex strings. Weak candidates
are strings that mean nothing alone: opaque mixed strings of 32 characters or more, names of
a user or key (``user=...``, ``key_id: ...``), and endpoints (URLs). They are reported only when parts that complete each other meet in one
scope, which reaches ``SCOPE`` code points around a part without passing an empty line:

* ``opaque``: with an access identifier, a user name or an endpoint;
* ``identity``: with an opaque string, an assignment or a long hex string;
* ``endpoint``: with an access identifier or identity, and also an assignment, hex or opaque string.

Overlap is distance 0. Opaque and hex strings that begin inside an endpoint count for it as
user information, as a query value, or as a path segment that is a token; a plain long path
does not. ``user:...@`` is the endpoint's own identity.

Parts are intervals of one document, so the interval join runs inside its row. Parts of one
kind never overlap each other and none holds a line break, so of each kind only the nearest on
either side can decide: one pass over the sorted parts carries the furthest ends so far, one
pass back the nearest beginnings, and empty lines clear both. Work grows with the number of parts;
nothing is shuffled and no text leaves the row.

Null text is empty: no spans, the digest of the empty string. Repeated rows each get
their own result, an empty table gives an empty one, other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import blocks, let, running

# Kinds and patterns of base findings, in the order that breaks ties.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ["assign", "access", "hex"]

# Own choices: weak parts.
OPAQUE = r"[A-Za-z0-9+/_-]{32,}"
IDENTITY = r"""(?i:username|user|login|client_id|key_id|access_key|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""(?:https?|postgres|mysql|mongodb|redis|amqp|ftp)://[^\x00-\x20"'<>]{4,}"""
WEAK_KINDS = ["opaque", "identity", "endpoint"]
SCOPE = 256
COMPLEMENTS = {
    "opaque": [["access", "identity", "endpoint"]],
    "identity": [["assign", "hex", "opaque"]],
    "endpoint": [["access", "identity"], ["assign", "hex", "opaque"]],
}
# Places of credentials in an endpoint: user information (a number before a slash is a port), what follows the name of a
# query value, and a path segment that is a token: 24 characters or more with small and capital letters, and three places
# where letters and digits touch.
PORT = r"^[a-z]+://[^/?#@:]*:[0-9]{1,5}/"
LOGIN = r"^[a-z]+://([^/?#@:]*:[^?#@]*|[^/?#@:]+)@"
NAMED_LOGIN = r"^[a-z]+://[^/?#@:]+:[^?#@]+@"
VALUE = r"^[^?#]*[?#][^=]*="
TOKEN = r"(?:^|/)(?=[A-Za-z0-9_-]{24})(?=[A-Z0-9_-]*[a-z])(?=[a-z0-9_-]*[A-Z])(?:[A-Za-z0-9_-]*?(?:[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9]))){3}"
EMPTY_LINE = r"\n(?=[ \t]*\n)"

KINDS = BASE_KINDS + WEAK_KINDS
BREAK, ASSIGNED, ACCESSED, HEXED, OPAQUED, NAMED, ADDRESS = range(-1, 6)
SPAN = "struct<s:int,k:int,e:int>"
PART = "struct<s:int,k:int,e:int,login:int,value:int,named:boolean,token:boolean,rooted:boolean>"
LEFT = "struct<who:int,what:int,us:int,ue:int,login:int,value:int,before:int,by_who:boolean,by_what:boolean,by_url:boolean,cover:int,own:boolean>"
RIGHT = "struct<who:int,assign:int,string:int,url:int,cover:int,beyond:int,own:boolean,keep:boolean>"


def found(text: Column, pattern: str, kind: int, holds: Callable[[Column], Column] | None = None, **facts: Callable[[Column], Column]) -> Column:
    """Parts of a pattern's matches, leftmost first and without overlap.

    The text is split at the matches; a match ends where the pieces and matches up to it end.
    ``holds`` filters the matches as strings; those it drops still count for the places. ``facts`` are fields of the part.
    """
    names = [field.split(":") for field in PART[len("struct<") : -1].split(",")][3:]

    def part(match: Column, end: Column) -> Column:
        told = [(facts[n](match) if n in facts else F.lit(None)).cast(t).alias(n) for n, t in names]
        return F.struct((end - F.length(match)).alias("s"), F.lit(kind).alias("k"), end.alias("e"), *told)

    def parts(matches: Column) -> Column:
        lengths = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.length(gap) + F.coalesce(F.length(m), F.lit(0)))
        ends = running(lengths, F.lit(0), lambda at, n: at + n, "int")
        wanted = lambda m: m.isNotNull() if holds is None else m.isNotNull() & holds(m)
        return F.array_compact(F.zip_with(matches, ends, lambda m, end: F.when(wanted(m), part(m, end))))

    none = F.array().cast(f"array<{PART}>")
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), parts)).otherwise(none)


def assign_holds(match: Column) -> Column:
    """Group 2 of an assignment has its least length."""
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_LEAST


def mixed(match: Column) -> Column:
    """With a digit, a small and a capital letter."""
    return match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")


def rendered(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def login_length(url: Column) -> Column:
    return F.when(url.rlike(PORT), 0).otherwise(F.length(F.regexp_extract(url, LOGIN, 0)))


def named_login(url: Column) -> Column:
    return ~url.rlike(PORT) & url.rlike(NAMED_LOGIN)


def value_place(url: Column) -> Column:
    """Where the first query value begins; null without one."""
    return F.when(url.rlike(VALUE), F.length(F.regexp_extract(url, VALUE, 0)))


def so(condition: Column) -> Column:
    """True or false; what is not known is false."""
    return F.coalesce(condition, F.lit(False))


def looked_left(state: Column, x: Column) -> Column:
    """What has been passed before a part, and whether a complement lies in its scope there.

    ``who`` and ``what`` are the furthest ends of names and of secrets. The last endpoint is held whole, as a
    string that begins in it counts only as a credential; then the endpoint ``before`` is the nearest other.
    """
    inside = so(x["s"] < state["ue"])
    value = so(x["s"] >= state["us"] + state["value"]) & ~so(x["rooted"])
    own = inside & (so(x["s"] < state["us"] + state["login"]) | value | so(x["token"]))
    near = lambda end: so(end >= x["s"] - SCOPE)
    url = x["k"] == ADDRESS

    def newer(name: str, *kinds: int) -> Column:
        return F.when(x["k"].isin(*kinds), F.greatest(state[name], x["e"])).otherwise(state[name])

    after = F.struct(
        newer("who", ACCESSED, NAMED).alias("who"),
        newer("what", ASSIGNED, HEXED, OPAQUED).alias("what"),
        F.when(url, x["s"]).otherwise(state["us"]).alias("us"),
        F.when(url, x["e"]).otherwise(state["ue"]).alias("ue"),
        F.when(url, x["login"]).otherwise(state["login"]).alias("login"),
        F.when(url, x["value"]).otherwise(state["value"]).alias("value"),
        F.when(url, state["ue"]).otherwise(state["before"]).alias("before"),
        near(state["who"]).alias("by_who"),
        near(state["what"]).alias("by_what"),
        F.when(inside, own | near(state["before"])).otherwise(near(state["ue"])).alias("by_url"),
        F.when(inside, state["us"]).alias("cover"),
        own.alias("own"),
    )
    return F.when(x["k"] != BREAK, after).otherwise(nothing(LEFT))


def looked_right(state: Column, y: Column) -> Column:
    """The nearest beginnings after a part (``y.x``, seen from the left as ``y.l``), and whether the part is kept.

    For an endpoint, strings inside it count if one is its own credential; ``beyond`` is the first string after it.
    """
    x, left = y["x"], y["l"]
    string = x["k"].isin(HEXED, OPAQUED)
    covered = string & left["cover"].isNotNull()
    enters = covered & ~left["cover"].eqNullSafe(state["cover"])
    near = lambda begin: so(begin <= x["e"] + SCOPE)
    by_who = left["by_who"] | near(state["who"])
    strings = F.when(state["cover"].eqNullSafe(x["s"]), so(state["own"]) | near(state["beyond"])).otherwise(near(state["string"]))
    keep = (
        F.when(x["k"] == OPAQUED, by_who | left["by_url"] | near(state["url"]))
        .when(x["k"] == NAMED, left["by_what"] | near(state["assign"]) | near(state["string"]))
        .when(x["k"] == ADDRESS, (by_who | so(x["named"])) & (left["by_what"] | near(state["assign"]) | strings))
        .otherwise(True)
    )
    before = F.struct(
        F.when(x["k"].isin(ACCESSED, NAMED), x["s"]).otherwise(state["who"]).alias("who"),
        F.when(x["k"] == ASSIGNED, x["s"]).otherwise(state["assign"]).alias("assign"),
        F.when(string, x["s"]).otherwise(state["string"]).alias("string"),
        F.when(x["k"] == ADDRESS, x["s"]).otherwise(state["url"]).alias("url"),
        F.when(covered, left["cover"]).otherwise(state["cover"]).alias("cover"),
        F.when(enters, state["string"]).otherwise(state["beyond"]).alias("beyond"),
        F.when(enters, left["own"]).when(covered, state["own"] | left["own"]).otherwise(state["own"]).alias("own"),
        keep.alias("keep"),
    )
    return F.when(x["k"] != BREAK, before).otherwise(nothing(RIGHT))


def nothing(kind: str) -> Column:
    """A struct of nulls."""
    names = [field.split(":") for field in kind[len("struct<") : -1].split(",")]
    return F.struct(*(F.lit(None).cast(t).alias(n) for n, t in names))


def linked(parts: Column) -> Column:
    """Spans of base parts, and of weak parts that have a complement of every needed sort in their scope."""

    def kept(sorted_parts: Column) -> Column:
        left = running(sorted_parts, nothing(LEFT), looked_left, LEFT)
        seen = F.reverse(F.arrays_zip(sorted_parts.alias("x"), left.alias("l")))
        return F.zip_with(sorted_parts, F.reverse(running(seen, nothing(RIGHT), looked_right, RIGHT)), span)

    def span(x: Column, right: Column) -> Column:
        return F.when(right["keep"], F.struct(x["s"], x["k"], x["e"]))

    return F.array_compact(let(F.array_sort(parts), kept))


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``spans``: arrays of (s, k, e), by start and then kind; k counts base kinds, then weak ones.

    Columns of these names are replaced; names that begin with two underscores are used in between.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = {
        "__assign": found(whole, ASSIGN, ASSIGNED, assign_holds),
        "__access": found(whole, ACCESS, ACCESSED),
        "__hex": found(whole, HEX, HEXED),
    }
    weak = {
        "__opaque": found(whole, OPAQUE, OPAQUED, mixed, token=lambda m: m.rlike(TOKEN), rooted=lambda m: m.startswith("/")),
        "__identity": found(whole, IDENTITY, NAMED),
        "__endpoint": found(whole, ENDPOINT, ADDRESS, login=login_length, value=value_place, named=named_login),
    }
    out = docs.withColumns(base | weak)
    out = out.withColumn("base_spans", F.transform(F.array_sort(F.concat(*base)), lambda x: F.struct(x["s"], x["k"], x["e"])))
    out = out.withColumn("__parts", F.when(F.size(F.concat(*weak)) > 0, F.concat(*base, *weak, found(whole, EMPTY_LINE, BREAK))))
    out = out.withColumn("spans", F.when(F.col("__parts").isNotNull(), linked(F.col("__parts"))).otherwise(F.col("base_spans")))
    return out.drop(*base, *weak, "__parts")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span with ``[SECRET]``; spans that touch or overlap become one, n_chars follows. Null text stays null."""
    whole, run = F.col(text), "struct<s:int,e:int>"

    def merged(state: Column, x: Column) -> Column:
        joins = so(x["s"] <= state["e"])
        return F.struct(F.when(joins, state["s"]).otherwise(x["s"]).alias("s"), F.when(joins, F.greatest(state["e"], x["e"])).otherwise(x["e"]).alias("e"))

    def last_of_runs(states: Column) -> Column:
        last = lambda x, i: so(F.get(states, i + 1)["s"] != x["s"]) | (i + 1 == F.size(states))
        return F.filter(states, last)

    def cleaned(group: Column, i: Column, groups: Column) -> Column:
        """The text from the end of the group before to the end of this one, its runs masked."""
        begin = F.when(i > 0, F.element_at(F.get(groups, i - 1), -1)["e"]).otherwise(0)

        def pieces(at: Column, part: Column) -> Column:
            def piece(x: Column, j: Column) -> Column:
                start = F.when(j > 0, F.get(group, j - 1)["e"]).otherwise(at)
                return F.concat(F.substring(part, start - at + 1, x["s"] - start), F.lit("[SECRET]"))

            return F.array_join(F.transform(group, piece), "")

        end = F.element_at(group, -1)["e"]
        return let(begin, lambda at: let(F.substring(whole, at + 1, end - at), lambda part: pieces(at, part)))

    def put_together(groups: Column) -> Column:
        end = F.element_at(F.element_at(groups, -1), -1)["e"]
        return F.concat(
            F.array_join(F.transform(groups, lambda g, i: cleaned(g, i, groups)), ""), F.substring(whole, end + 1, F.length(whole))
        )

    runs = let(running(F.col("spans"), nothing(run), merged, run), last_of_runs)
    out = scan_secrets(docs, text)
    new = F.when(F.size("spans") > 0, let(blocks(runs), put_together)).otherwise(whole)
    out = out.withColumn(text, new).select(docs.columns)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def oracle_sql() -> str:
    """The same result in SQL, over ``documents``: every part is held against every other of its document."""
    holds = {
        "assign": f"length(regexp_extract(m[i], $${ASSIGN}$$, 2)) >= {ASSIGN_LEAST}",
        "opaque": "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[a-z]') AND regexp_matches(m[i], '[A-Z]')",
    }
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, OPAQUE, IDENTITY, ENDPOINT), strict=True))
    found = " UNION ALL ".join(
        f"""
        SELECT rid, t, {k} AS k, s, s + length(w) AS e, w FROM (
          SELECT rid, t, m[i] AS w,
            CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
          FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT rid, t, regexp_extract_all(t, $${pattern}$$) AS m, regexp_split_to_array(t, $${pattern}$$) AS g FROM docs))
          WHERE {holds.get(kind, "true")})
        """
        for k, (kind, pattern) in enumerate(patterns.items())
    )
    touches = "len(list_filter(range(1, length(r)), lambda j: regexp_matches(substring(r, j, 2), '^([0-9][A-Za-z]|[A-Za-z][0-9])$'))) >= 3"
    token = (
        "len(list_filter(regexp_extract_all(w, '(^|/)([A-Za-z0-9_-]+)', 2), "
        f"lambda r: length(r) >= 24 AND regexp_matches(r, '[a-z]') AND regexp_matches(r, '[A-Z]') AND {touches})) > 0"
    )
    facts = f"""
        CASE WHEN regexp_matches(w, $${PORT}$$) THEN 0 ELSE length(regexp_extract(w, $${LOGIN}$$)) END AS login,
        NOT regexp_matches(w, $${PORT}$$) AND regexp_matches(w, $${NAMED_LOGIN}$$) AS named,
        length(regexp_extract(w, $${VALUE}$$)) AS value,
        k = {OPAQUED} AND {token} AS token
    """

    def credential(url: str, part: str) -> str:
        value = f"({url}.value > 0 AND {part}.s >= {url}.s + {url}.value AND NOT starts_with({part}.w, '/'))"
        return f"({part}.s < {url}.s + {url}.login OR {value} OR {part}.token)"

    def apt(kind: str) -> str:
        if kind == "endpoint":
            return f"(y.k NOT IN ({HEXED}, {OPAQUED}) OR y.s < x.s OR y.s >= x.e OR {credential('x', 'y')})"
        if kind == "opaque":
            return f"(y.k <> {ADDRESS} OR x.s < y.s OR x.s >= y.e OR {credential('y', 'x')})"
        return "true"

    def meets(kind: str, sort: list[str]) -> str:
        wanted = ", ".join(str(KINDS.index(s)) for s in sort)
        apart = "greatest(y.s - x.e, x.s - y.e)"
        between = f"substring(x.t, CAST(least(x.e, y.e) + 1 AS BIGINT), CAST(greatest({apart}, 0) AS BIGINT))"
        own = "x.named OR " if kind == "endpoint" and "identity" in sort else ""
        return (
            f"({own}EXISTS (SELECT 1 FROM parts y WHERE y.rid = x.rid AND y.k IN ({wanted}) "
            f"AND {apart} <= {SCOPE} AND {apt(kind)} AND NOT regexp_matches({between}, '\\n[ \\t]*\\n')))"
        )

    weak = " OR ".join(f"(x.k = {KINDS.index(k)} AND {' AND '.join(meets(k, sort) for sort in COMPLEMENTS[k])})" for k in WEAK_KINDS)
    name = "CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    listed = f"coalesce(string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, k)"
    counts = ", ".join(f"count(*) FILTER (k = {i}) AS n_{k}" for i, k in enumerate(BASE_KINDS))
    return f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
      parts AS MATERIALIZED (SELECT *, {facts} FROM ({found})),
      kept AS (SELECT x.rid, x.k, x.s, x.e FROM parts x WHERE x.k < {len(BASE_KINDS)} OR {weak})
    SELECT doc_id, {counts}, sha256({listed} FILTER (k < {len(BASE_KINDS)}), '')) AS base_sha256, {listed} FILTER (k IS NOT NULL), '') AS spans
    FROM docs LEFT JOIN kept USING (rid) GROUP BY rid, doc_id
    """
