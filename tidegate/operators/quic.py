"""QUIC traffic by client: both directions of a client under its own address, acknowledgement frames, early amplification.

A client is the source of a packet to a service port and the destination of one from it. One pass over the payloads
gives frames, header kinds and directions; they are summed up for each (window, client), then for each window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions import quic as Q
from tidegate.functions import traffic as T
from tidegate.operators import counters as K
from tidegate.operators import rules as R
from tidegate.operators import ticks

c = F.col


# The limits of the detector.
@dataclass(frozen=True)
class QuicLimits:
    """packets: least of a window; attack: share; ratio: bytes out to bytes in; acks: of one client; heavy_acks: from
    which a client is heavy; many, some: heavy clients without and with attack traffic; rfc: what the protocol allows."""

    packets: int = 500
    attack: float = 0.05
    ratio: float = 2.2
    acks: int = 10_000
    heavy_acks: int = 5_000
    many: int = 20
    some: int = 5
    rfc: float = 3.0


def quic_rows(packets: DataFrame, ports: tuple[int, ...] = (443, 8443)) -> DataFrame:
    """The valid QUIC packets of ``packets`` (with payload): ts, client, inbound, header, attack, pkt_len, acks, largest."""
    ours = lambda x: F.coalesce(c(x).isin(*ports), F.lit(False))
    rows = packets.where((c("proto") == T.UDP) & (ours("src_port") | ours("dst_port")) & Q.is_valid(c("payload")))
    inbound = ours("dst_port")
    rows = rows.select("ts", F.when(inbound, c("src_ip")).otherwise(c("dst_ip")).alias("client"), inbound.alias("inbound"), Q.header_kind(c("payload")).alias("header"), "pkt_len", "payload")
    rows = Q.ack_frames(rows, ("ts", "client", "inbound", "header", "pkt_len"))
    return rows.withColumn("attack", c("inbound") & (T.network_class(c("client")) == "attack"))


def client_counters(rows: DataFrame, width: str = "5 seconds") -> DataFrame:
    """For each window and client: packets, long, short, attack, acks, acks_in (those that it sent), bytes_in, bytes_out."""
    n = lambda cond: T.count_where(cond)
    bytes_of = lambda cond: F.sum(F.when(cond, c("pkt_len")).otherwise(0).cast("long"))
    sums = {"packets": F.count("*"), "long": n(c("header") == "long"), "short": n(c("header") == "short"), "attack": n(c("attack")), "acks": F.sum("acks"), "acks_in": F.sum(F.when(c("inbound"), c("acks")).otherwise(0)), "bytes_in": bytes_of(c("inbound")), "bytes_out": bytes_of(~c("inbound"))}
    return rows.groupBy(K.window_start(width).alias("w"), "client").agg(*[v.alias(k) for k, v in sums.items()])


def window_counters(clients: DataFrame, heavy_acks: int = QuicLimits.heavy_acks) -> DataFrame:
    """For each window: the sums over clients, out_in_ratio, the greatest max_client_ratio, ack_ips, max_acks and heavy_ackers."""
    sums = ("packets", "long", "short", "attack", "acks", "bytes_in", "bytes_out")
    ratio = F.when(c("bytes_in") > 0, c("bytes_out") / c("bytes_in")).otherwise(0.0)
    by = clients.withColumn("ratio", ratio).groupBy("w").agg(*[F.sum(x).alias(x) for x in sums], F.round(F.max("ratio"), 6).alias("max_client_ratio"), T.count_where(c("acks_in") > 0).alias("ack_ips"), F.max("acks_in").alias("max_acks"), T.count_where(c("acks_in") > heavy_acks).alias("heavy_ackers"))
    return by.transform(K.named).withColumn("out_in_ratio", T.ratio(c("bytes_out"), c("bytes_in")))


def window_rules(limits: QuicLimits = QuicLimits()) -> list[R.Rule]:
    """Rules over ``window_counters``, in the order of their reasons."""
    attacked = c("attack") > limits.attack * c("packets")
    return [
        R.Rule("ACK_RATE", "HIGH", attacked & (c("max_acks") > limits.acks)),
        R.Rule("AMPLIFICATION", "HIGH", c("bytes_out") > limits.ratio * c("bytes_in")),
        R.Rule("HEAVY_ACKERS", "MEDIUM", (c("heavy_ackers") > limits.many) | ((c("heavy_ackers") > limits.some) & (c("attack") > 0))),
    ]


def early_amplification(rows: DataFrame, limits: QuicLimits = QuicLimits(), window: str = "5 seconds", pane: str = "100 milliseconds") -> DataFrame:
    """The first pane of each window at whose end all conditions hold: win, pane, packets, attack, bytes_in, bytes_out,
    ratio, margin (to what the protocol allows), saved_pct and mb."""
    n = lambda cond: cond.cast("long")
    sums: dict[str, Column] = {"packets": F.lit(1).cast("long"), "attack": n(c("attack")), "bytes_in": n(c("inbound")) * c("pkt_len"), "bytes_out": n(~c("inbound")) * c("pkt_len")}
    fires = (c("packets") >= limits.packets) & (c("attack") > limits.attack * c("packets")) & (c("bytes_out") > limits.ratio * c("bytes_in"))
    found = ticks.first_crossing(rows, window, pane, sums, fires)
    ratio = F.when(c("bytes_in") > 0, c("bytes_out") / c("bytes_in")).otherwise(0.0)
    return found.withColumns({"ratio": F.round(ratio, 6), "margin": F.round(limits.rfc - ratio, 6), "saved_pct": F.round((limits.rfc - ratio) / limits.rfc * 100, 6), "mb": F.round((c("bytes_in") + c("bytes_out")) / (1024 * 1024), 9)})
