"""Scalar formulas as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quota of a dollar, the zone of business days, the upper edges of the histograms (seconds, milliseconds).
QUOTA_PER_USD = 500000
DAY, ZONE = 86400, 28800
LATENCY_EDGES, TTFT_EDGES = (1, 2, 5, 10, 30, 60), (500, 1000, 2000, 5000, 10000)
LATENCY = ("lat_1", "lat_2", "lat_5", "lat_10", "lat_30", "lat_60", "lat_inf")
TTFT = ("ttft_500", "ttft_1k", "ttft_2k", "ttft_5k", "ttft_10k", "ttft_inf")


def div(a: Column | str, b: int) -> Column:
    return F.floor((F.col(a) if isinstance(a, str) else a) / F.lit(b)).cast("long")


def bucket(ts: str, step: int) -> Column:
    return (F.col(ts) - F.pmod(F.col(ts), F.lit(step))).cast("long")


def day(ts: str) -> Column:
    """The start of the business day (UTC+8), in seconds."""
    return zoned_bucket(ts, DAY)


def zoned_bucket(ts: str, step: int) -> Column:
    shifted = F.col(ts) + ZONE
    return (shifted - F.pmod(shifted, F.lit(step)) - ZONE).cast("long")


def rate(part: Column, whole: Column) -> Column:
    """Per cent, 0 of nothing."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def rate_or_null(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100)


def health(total: Column, per_cent: Column) -> Column:
    return F.when(total < 20, "nosample").when(per_cent >= 99, "good").when(per_cent >= 95, "warn").otherwise("bad")


def percentile(hist: list[str], edges: tuple[int, ...], largest: str, p: float) -> Column:
    """The percentile of a histogram by linear interpolation; its last bin ends at the largest value seen."""
    counts = F.array(*(F.col(c).cast("double") for c in hist))
    uppers = F.array(*(F.lit(float(e)) for e in edges), F.col(largest).cast("double"))
    total = reduce(lambda a, b: a + b, (F.col(c) for c in hist)).cast("double")
    target = F.lit(p / 100) * total

    def step(acc: Column, x: Column) -> Column:
        upper = F.greatest(x["upper"], acc["lower"])
        reached = acc["cum"] + x["n"] >= target
        inside = F.when(x["n"] == 0, upper).otherwise(acc["lower"] + (target - acc["cum"]) / F.nullif(x["n"], F.lit(0.0)) * (upper - acc["lower"]))
        return F.struct(
            F.when(acc["result"].isNull(), acc["cum"] + x["n"]).otherwise(acc["cum"]).alias("cum"),
            F.when(acc["result"].isNull(), upper).otherwise(acc["lower"]).alias("lower"),
            F.coalesce(acc["result"], F.when(reached, inside)).alias("result"),
        )

    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("lower"), F.lit(None).cast("double").alias("result"))
    bins = F.transform(F.arrays_zip(counts.alias("n"), uppers.alias("upper")), lambda b: F.struct(b["n"].alias("n"), b["upper"].alias("upper")))
    end = F.aggregate(bins, start, step)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.coalesce(end["result"], end["lower"]))


#: Fixed patterns of what must not be kept of an error text, in the order in which they apply, with their substitutes.
REDACTIONS = (
    (r"(?i)\b(authorization|api[-_ ]?key|access[-_ ]?token|refresh[-_ ]?token|secret)\s*[:=]\s*(?:bearer\s+)?[^\s,;]+", "$1=<redacted>"),
    (r"(?i)\bbearer\s+[a-z0-9._~+/=-]{8,}", "Bearer <redacted>"),
    (r"(?i)\b(?:sk|rk|pk|sess|token)-[a-z0-9_-]{8,}", "<credential>"),
    (r"(?i)([?&](?:token|key|api_key|access_token|signature)=)[^&\s]+", "$1<redacted>"),
    (r"(?i)\b[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+\b", "<email>"),
    (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?\b", "<ip>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<uuid>"),
    (r"\b[a-zA-Z0-9_-]{32,}\b", "<opaque-id>"),
    (r"\s+", " "),
)
STATUS_CODE = r"(?i)(?:status[_ ]?code|http[_ ]?status|response\s+status\s+code|unexpected\s+status|code)\s*(?:[=:]\s*|\s+)([0-9]{3})"
MOST_CHARACTERS = 4096


def redacted(text: Column) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), REDACTIONS, F.trim(text))


def signature(source: Column, text: Column) -> Column:
    return F.sha2(F.concat(source.cast("binary"), F.unhex(F.lit("00")), text.cast("binary")), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC by composition, on binary columns."""
    block = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def clean_list(text: Column) -> Column:
    """Parts of a comma list, trimmed, without blanks and repeats, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")))


def masked_key(key: Column) -> Column:
    """What may be shown of a key: nothing of up to four characters, two and two of up to eight, four and four of longer ones."""
    n = F.length(key)
    ends = lambda k, stars: F.concat(F.lit("sk-"), F.substring(key, 1, k), F.lit("*" * stars), F.right(key, F.lit(k)))
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).when(n <= 8, ends(2, 4)).otherwise(ends(4, 10))


#: Fixed value: a word that only texts of the gateway itself hold.
INTERNAL_WORD = "渠道"


def scrubbed(content: Column) -> Column:
    """A text as members may see it: nothing of one that speaks of internals."""
    return F.when(content.contains(INTERNAL_WORD), "").otherwise(content)


def provider(model: Column) -> Column:
    m = F.lower(model)
    openai = reduce(lambda a, b: a | b, (m.startswith(p) for p in ("gpt", "o1", "o3", "o4", "chatgpt", "dall")), m.contains("codex"))
    known = (("claude", "anthropic"), ("gemini", "google"), ("deepseek", "deepseek"), ("glm", "zhipu"))
    named = reduce(lambda w, p: w.when(m.startswith(p[0]), p[1]), known[1:], F.when(m.startswith(known[0][0]), known[0][1]))
    return named.when(openai, "openai").otherwise("other")


def host(url: Column) -> Column:
    """The lower-case host name of a URL, without port, path and user."""
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))


#: Routes and methods that are reported by name.
ROUTES = ("/v1/chat/completions", "/v1/responses", "/v1/messages", "/v1/models", "/api/status")
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def route(path: Column) -> Column:
    """One of a closed list of routes; a null path is ``/other``."""
    plain = F.trim(F.substring_index(F.coalesce(path, F.lit("")), "?", 1))
    return F.when(plain.isin(*ROUTES), plain).when(plain.startswith("/v1/"), "/v1/*").when(plain.startswith("/api/"), "/api/*").otherwise("/other")


def method(name: Column) -> Column:
    upper = F.upper(F.trim(name))
    return F.when(upper.isin(*METHODS), upper).otherwise("OTHER")


def first_number(text: Column) -> Column:
    """The number before the first comma; 0 if there is none, null if it is no finite number."""
    first = F.trim(F.substring_index(F.coalesce(text, F.lit("")), ",", 1))
    return F.when(first.isin("", "-"), 0.0).otherwise(finite(first.try_cast("double")))


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def has_attempts(chain: Column) -> Column:
    """Whether a chain of attempts such as ``0.1, 0.2 : 0.3`` is there at all."""
    return ~F.coalesce(chain, F.lit("")).isin("", "-")


def last_number(chain: Column) -> Column:
    """The last attempt's number; null if any attempt, as one without a number among others, is none."""
    parts = F.transform(F.filter(F.split(chain, "[,:]"), lambda x: x != ""), lambda x: F.trim(x).try_cast("double"))
    last = lambda p: F.when((F.size(p) > 0) & F.forall(p, lambda x: x.isNotNull()), finite(F.get(p, F.size(p) - 1)))
    return F.get(F.transform(F.array(parts), last), F.lit(0))  # bound by the transform, so the chain is split once


def band(share: Column) -> Column:
    return F.when(share >= 0.99, "up").when(share >= 0.5, "warn").otherwise("down")


def digest(*columns: str) -> Column:
    """An order-independent digest of a group's rows, as an aggregate that needs no list of them: sum, xor and count of row hashes."""
    h = F.xxhash64(*columns)
    return F.concat_ws(":", F.count("*").cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string"))


def usd(quota: Column) -> Column:
    return quota / QUOTA_PER_USD


def row_text(*columns: Column) -> Column:
    """A row's values as one text: each with its length before it, a null unlike a blank, so no two rows have the same."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws("|", *parts)


#: Hexadecimal digits of a SHA-256 that one sum of a multiset hash takes (60 bits, so 2^63 rows stay below 38 digits), and how many sums.
LANE_DIGITS, LANES = 15, 4


def multiset_hash(items: Column, fields: list[str]) -> Column:
    """SHA-256 of an array of structs as a multiset: the order of its items makes no difference, their number does.

    Each item's SHA-256 is cut into lanes that are added up over the array, so nothing is sorted; the hash is that of the
    number of items and the sums. Null and empty arrays have the same hash.
    """
    hashes = F.transform(items, lambda x: F.sha2(row_text(*(x[f] for f in fields)), 256))
    zero = F.lit(0).cast("decimal(38,0)")

    def lane(at: int) -> Column:
        number = lambda h: F.conv(F.substring(h, at, LANE_DIGITS), 16, 10).cast("decimal(38,0)")
        return F.coalesce(F.aggregate(hashes, zero, lambda total, h: (total + number(h)).cast("decimal(38,0)")), zero)

    sums = [lane(1 + LANE_DIGITS * i) for i in range(LANES)]
    size = F.coalesce(F.array_size(items), F.lit(0))
    return F.sha2(F.concat_ws(":", size.cast("string"), *(s.cast("string") for s in sums)), 256)
