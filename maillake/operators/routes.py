"""Received headers: hops, networks and clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maillake.functions.dates import parse_header_date



def routing_table(msgs: DataFrame, id_col: str = "rowid", headers: str = "headers") -> DataFrame:
    """One row per Received hop (hop 0 = nearest to the recipient): from-host, by-host, IP and the hop's time.

    ``hop_utc`` is the date after the last semicolon with its zone taken off; ``date_text`` is that date as written.
    """
    rec = msgs.select(id_col, F.posexplode(F.filter(F.col(headers),
                                                     lambda h: F.lower(h["name"]) == "received")).alias("hop", "h"))
    v = F.col("h.value")
    cut = F.length(v) - F.length(F.substring_index(v, ";", -1))         # up to and with the last semicolon; 0 without one
    path = F.when(cut > 0, F.substring(v, F.lit(1), cut - 1)).otherwise(v)

    def grab(rx, c=path):
        x = F.regexp_extract(c, rx, 1)
        return F.when(x != "", x)
    date = F.when(cut > 0, F.trim(F.substr(v, cut + 1)))
    return rec.select(id_col, "hop", grab(r"(?i)\bfrom\s+([^\s;]+)").alias("from_host"), grab(r"(?i)\bby\s+([^\s;]+)").alias("by_host"),
                      grab(r"(?i)\bfrom\s.*?[\[(](?:IPv6:)?((?:\d{1,3}\.){3}\d{1,3}|[0-9a-f]*:[0-9a-f:]*:[0-9a-f:.]*)[\])]").alias("ip"),
                      F.when(date != "", date).alias("date_text"), parse_header_date(date)["utc"].alias("hop_utc"))


# --- R10: address to network ---------------------------------------------------------
def address_bits(ip: Column) -> Column:
    """An IPv4 or IPv6 address as a text of 32 or 128 binary digits; null for what is neither."""
    v4 = F.transform(F.split(ip, r"\."), lambda x: F.lpad(F.conv(x, 10, 2), 8, "0"))
    is_v4 = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    # an IPv4 tail of an IPv6 address is two groups
    tail = F.regexp_extract(ip, r"((?:\d{1,3}\.){3}\d{1,3})$", 1)
    octets = F.split(tail, r"\.")
    groups = [F.lower(F.conv((F.try_element_at(octets, F.lit(i)).cast("int") * 256 + F.try_element_at(octets, F.lit(i + 1)).cast("int")).cast("string"), 10, 16))
              for i in (1, 3)]
    text = F.when(tail != "", F.concat(F.substring(ip, F.lit(1), F.length(ip) - F.length(tail)), groups[0], F.lit(":"), groups[1])).otherwise(ip)
    left, right = F.substring_index(text, "::", 1), F.when(text.contains("::"), F.substring_index(text, "::", -1))

    def parts(c):
        return F.filter(F.split(c, ":"), lambda x: x != "")

    given = F.size(parts(left)) + F.coalesce(F.size(parts(right)), F.lit(0))
    whole = F.when(right.isNull(), parts(left)).when(given < 8, F.concat(parts(left), F.array_repeat(F.lit("0"), 8 - given), parts(right)))
    v6 = F.transform(whole, lambda x: F.lpad(F.conv(x, 16, 2), 16, "0"))
    run = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"
    good = text.rlike(f"^(?:{run})?(?:::(?:{run})?)?$") & (F.size(whole) == 8)
    return F.when(is_v4, F.array_join(v4, "")).when(good, F.array_join(v6, ""))


def network_bits(cidr: Column) -> Column:
    """The fixed digits of a network ``address/length``, led by its family (``4`` or ``6``); null for what is none."""
    bits, length = address_bits(F.substring_index(cidr, "/", 1)), F.substring_index(cidr, "/", -1).try_cast("int")
    family = F.when(F.length(bits) == 32, F.lit("4")).otherwise(F.lit("6"))
    return F.when(cidr.contains("/") & length.between(0, F.length(bits)), F.concat(family, F.substring(bits, F.lit(1), length)))


def with_network(df: DataFrame, ip: str, networks: DataFrame, cidr: str = "network") -> DataFrame:
    """Every row with the longest network of the list that holds its address (the list's columns; null if none does).

    Each distinct address is exploded to its prefixes of the lengths that the list has (129 + 33 at most), these meet the
    list by an equi-join, and the longest wins.  Of a network listed twice, the least row wins.
    """
    from maillake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    own = [c for c in networks.columns if c != cidr]
    nets = (networks.withColumn("_net", network_bits(F.col(cidr))).checkpoint().filter("_net IS NOT NULL")
            .groupBy("_net").agg(F.min(F.struct(F.col(cidr), *own)).alias("_row")))
    lengths = [r[0] for r in nets.select(F.length("_net")).distinct().collect()]         # 162 at most
    bits = address_bits(F.col(ip))
    whole = F.concat(F.when(F.length(bits) == 32, F.lit("4")).otherwise(F.lit("6")), bits)
    # checkpointed: the digits are long to work out, and each of the lengths asks for them
    each = df.select(ip).distinct().withColumn("_bits", whole).checkpoint().filter("_bits IS NOT NULL")
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("_bits")),
                           lambda n: F.substring(F.col("_bits"), F.lit(1), n))
    best = (each.select(ip, F.explode(prefixes).alias("_net")).join(nets, "_net")
            .groupBy(ip).agg(F.max_by("_row", F.length("_net")).alias("_row")))
    return df.join(best, ip, "left").select("*", f"_row.{cidr}", *[f"_row.{c}" for c in own]).drop("_row")


def moves(hops: DataFrame, person: str, ts: str, network: str) -> DataFrame:
    """Per person and month the network most of their mail came from (ties: the greater), and whether it changed ("has moved").

    A month without mail from a known network is no month here.
    """
    months = hops.filter(F.col(network).isNotNull()).withColumn("month", F.trunc(F.to_date(ts), "month"))
    count = months.groupBy(person, "month", network).agg(F.count(F.lit(1)).alias("n"))
    most = count.groupBy(person, "month").agg(F.max_by(network, F.struct("n", network)).alias(network))
    before = F.lag(network).over(Window.partitionBy(person).orderBy("month"))       # a row a month
    return most.withColumn("moved", F.coalesce(before != F.col(network), F.lit(False)))


# --- R11: clocks ------------------------------------------------------------------------
CLOCK_ROUNDS = 12


def hop_delays(routes: DataFrame, id_col: str = "rowid") -> DataFrame:
    """(id, hop, from_relay, to_relay, delay_s): the time between two neighbouring hops of a message, by their own clocks."""
    before = Window.partitionBy(id_col).orderBy("hop")       # a message's hops
    both = (routes.select(id_col, "hop", F.col("by_host").alias("to_relay"), F.col("hop_utc").alias("_to"),
                          F.lead("by_host").over(before).alias("from_relay"), F.lead("hop_utc").over(before).alias("_from"))
            .filter("to_relay IS NOT NULL AND from_relay IS NOT NULL AND _to IS NOT NULL AND _from IS NOT NULL"))
    seconds = (F.unix_micros(F.col("_to").cast("timestamp")) - F.unix_micros(F.col("_from").cast("timestamp"))) / 1e6
    return both.select(id_col, "hop", "from_relay", "to_relay", seconds.alias("delay_s"))


def clock_offsets(delays: DataFrame, rounds: int = CLOCK_ROUNDS) -> DataFrame:
    """(relay, offset_s, links): how far each relay's clock is ahead, against the relay with most links of its network.

    A delay is the true one plus the difference of two clocks.  Each pair of relays, taken in both directions, gives a
    median difference; then, in a fixed number of rounds, every relay takes the median of what its neighbours make of
    it.  Where mail goes both ways between two relays, equal delays cancel; one-way pairs count the network's least
    delay as clock.  All work is on one row for each pair of relays; rounds are checkpointed.
    """
    from maillake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(delays.sparkSession)
    one = (delays.filter("from_relay <> to_relay").groupBy("from_relay", "to_relay")
           .agg(F.percentile_approx("delay_s", 0.5, 10_000).alias("d"), F.count(F.lit(1)).alias("n")))
    back = one.select(F.col("to_relay").alias("from_relay"), F.col("from_relay").alias("to_relay"), F.col("d").alias("b"), F.col("n").alias("m"))
    # how far ``to`` is ahead of ``from``
    ahead = F.when(F.col("d").isNull(), -F.col("b")).when(F.col("b").isNull(), F.col("d")).otherwise((F.col("d") - F.col("b")) / 2)
    pairs = (one.join(back, ["from_relay", "to_relay"], "full")
             .select(F.col("from_relay").alias("a"), F.col("to_relay").alias("relay"), ahead.alias("ahead"),
                     (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")).checkpoint())
    links = pairs.groupBy("relay").agg(F.sum("n").alias("links"))
    # the relay with most links is right; others start from nothing and are set by neighbours that are
    first = links.agg(F.max_by("relay", F.struct("links", "relay"))).first()[0]
    now = links.select("relay", F.when(F.col("relay") == F.lit(first), F.lit(0.0)).alias("offset_s"), "links")
    for _ in range(rounds):
        told = (pairs.join(now.select(F.col("relay").alias("a"), F.col("offset_s").alias("o")).filter("o IS NOT NULL"), "a")
                .groupBy("relay").agg(F.percentile_approx(F.col("o") + F.col("ahead"), 0.5, 10_000).alias("t")))
        now = (now.join(told, "relay", "left")
               .select("relay", F.when(F.col("relay") == F.lit(first), F.lit(0.0)).otherwise(F.coalesce("t", "offset_s")).alias("offset_s"), "links")
               .checkpoint())
    return now
