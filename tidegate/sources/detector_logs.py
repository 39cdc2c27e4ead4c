"""Text logs of detectors as a splittable source of multi-line records, their fields, and writers of the same form.

A log is a file of boxes: a banner with a title, then lines of labelled figures up to the next banner. The text source
reads it with the title as record separator, so a large file is read by many tasks, each of which starts at the first
title of its byte range; ranges know their file and offset. Blocks are numbered along (file, offset) in two levels:
within a range by order, and over ranges by the counts of the ranges before, so no file meets in one task. What a
block inherits from earlier ones (the first latency of its file) travels with these range rows.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col

#: Colour codes of terminals.
COLOUR = "\x1b\\[[0-9;]*m"


@dataclass(frozen=True)
class Layout:
    """title: what separates blocks. fields: name, type, pattern (its first group is the value). zero: whether a figure
    that a block lacks is 0 (else null). needed: the figure without which, or with 0 of it, a block does not count."""

    title: str
    fields: tuple[tuple[str, str, str], ...]
    lines: tuple[str, ...]
    zero: bool = False
    needed: str | None = None
    interval_s: int = 5

    @property
    def columns(self) -> list[str]:
        return [x for x, _, _ in self.fields]


# Titles, labels and forms of the detectors' logs. Labels of subnets may be any.
AGGREGATE = Layout(
    title="DDoS DETECTOR - STATISTICS",
    fields=(
        ("total_packets", "long", r"Total packets:\s+(\d+)"),
        ("baseline_packets", "long", r"Baseline \([^)\n]*\):\s+(\d+)"),
        ("baseline_percent", "double", r"Baseline \([^)\n]*\):\s+\d+\s+\((\d+\.\d+)%\)"),
        ("attack_packets", "long", r"Attack \([^)\n]*\):\s+(\d+)"),
        ("attack_percent", "double", r"Attack \([^)\n]*\):\s+\d+\s+\((\d+\.\d+)%\)"),
        ("tcp_packets", "long", r"TCP packets:\s+(\d+)"),
        ("udp_packets", "long", r"UDP packets:\s+(\d+)"),
        ("icmp_packets", "long", r"ICMP packets:\s+(\d+)"),
        ("baseline_gbps", "double", r"Baseline \([^)\n]*\):[^\n]+\s+(\d+\.\d+) Gbps"),
        ("attack_gbps", "double", r"Attack \([^)\n]*\):[^\n]+\s+(\d+\.\d+) Gbps"),
        ("total_gbps", "double", r"Total throughput:\s+(\d+\.\d+) Gbps"),
        ("cumulative_mpps", "double", r"Total received:[^(\n]+\((\d+\.\d+) Mpps\)"),
        ("cumulative_gbps", "double", r"\| (\d+\.\d+) Gbps \|"),
        ("syn_packets", "long", r"SYN packets:\s+(\d+)"),
        ("syn_ack_packets", "long", r"SYN-ACK packets:\s+(\d+)"),
        ("syn_ack_ratio", "double", r"SYN/ACK ratio:\s+(\d+\.\d+)"),
        ("http_requests", "long", r"HTTP requests:\s+(\d+)"),
        ("dns_queries", "long", r"DNS queries:\s+(\d+)"),
        ("udp_flood_events", "long", r"UDP flood events:\s+(\d+)"),
        ("syn_flood_events", "long", r"SYN flood events:\s+(\d+)"),
        ("http_flood_events", "long", r"HTTP flood events:\s+(\d+)"),
        ("icmp_flood_events", "long", r"ICMP flood events:\s+(\d+)"),
        ("dns_amp_events", "long", r"DNS amp events:\s+(\d+)"),
        ("alert_level", "string", r"Alert level:\s+(\w+)"),
        ("alert_reason", "string", r"(?s)Reason:\s+(.+?)(?=\n\[|\nReceive Side Scaling|\z)"),
        ("throughput_mpps", "double", r"Throughput:\s+[\d.]+\s+Gbps\s+\((\d+\.\d+) Mpps\)"),
        ("cycles_per_pkt", "long", r"Cycles available:\s+(\d+) cycles/pkt"),
        ("active_ips", "long", r"Active IPs:\s+(\d+)"),
        ("rx_packets_nic", "long", r"RX packets \(NIC\):\s+(\d+)"),
        ("rx_dropped", "long", r"RX dropped \(HW\):\s+(\d+)"),
        ("rx_no_mbufs", "long", r"RX no mbufs:\s+(\d+)"),
        ("rx_errors", "long", r"RX errors:\s+(\d+)"),
        ("detection_latency_ms", "double", r"First Detection Latency:\s+(\d+\.\d+) ms"),
        ("improvement_factor", "double", r"Improvement:\s+(\d+\.\d+)× faster"),
        ("packets_until_detection", "long", r"Packets until detection:\s+(\d+)"),
        ("sketch_memory_kb", "double", r"Total sketch memory:\s+(\d+) KB"),
        ("sketch_sampling_rate", "long", r"Sampling rate:\s+1 in (\d+) packets"),
        ("sketch_updates", "long", r"Attack traffic sampled:\s+(\d+) updates"),
    ),
    lines=(
        "[PACKET COUNTERS]", "  Total packets:      {total_packets}", "  Baseline ({net}.1.x): {baseline_packets} ({baseline_percent:.1f}%)", "  Attack ({net}.2.x):   {attack_packets} ({attack_percent:.1f}%)", "  TCP packets:        {tcp_packets}", "  UDP packets:        {udp_packets}", "  ICMP packets:       {icmp_packets}", "",
        "[INSTANTANEOUS TRAFFIC - Last 5.0 seconds]", "  Baseline ({net}.1.x): {baseline_packets} pkts  {baseline_gbps:.2f} Gbps", "  Attack ({net}.2.x): {attack_packets} pkts  {attack_gbps:.2f} Gbps", "  Total throughput:   {total_gbps:.2f} Gbps  (avg pkt: 314 bytes)", "",
        "[CUMULATIVE TRAFFIC - Since first packet]", "  Total received:     {rx_packets_nic} pkts ({cumulative_mpps:.2f} Mpps) | {cumulative_gbps:.2f} Gbps | 1 bytes", "",
        "[ATTACK-SPECIFIC COUNTERS]", "  SYN packets:        {syn_packets}", "  SYN-ACK packets:    {syn_ack_packets}", "  SYN/ACK ratio:      {syn_ack_ratio:.2f}", "  HTTP requests:      {http_requests}", "  DNS queries:        {dns_queries}", "",
        "[ATTACK DETECTIONS - Cumulative Events]", "  UDP flood events:   {udp_flood_events}", "  SYN flood events:   {syn_flood_events}", "  HTTP flood events:  {http_flood_events}", "  ICMP flood events:  {icmp_flood_events}", "  DNS amp events:     {dns_amp_events}", "",
        "[ALERT STATUS]", "  Alert level:        \x1b[91m{alert_level}\x1b[0m", "  Reason:             {alert_reason}", "",
        "[DETECTION PERFORMANCE]", "  First Detection Latency:   \x1b[92m{detection_latency_ms:.2f} ms\x1b[0m", "    Improvement:             {improvement_factor:.1f}× faster", "  Packets until detection:   {packets_until_detection}", "",
        "[SKETCH METRICS]", "  Total sketch memory:       {sketch_memory_kb:.0f} KB (14 workers)", "  Sampling rate:             1 in {sketch_sampling_rate} packets (3.1% overhead)", "  Attack traffic sampled:    {sketch_updates} updates", "",
        "[PERFORMANCE METRICS]", "  Throughput:         {total_gbps:.2f} Gbps ({throughput_mpps:.2f} Mpps)", "  Cycles available:   {cycles_per_pkt} cycles/pkt (lower = higher load)", "  Active IPs:         {active_ips}", "",
        "[NIC STATISTICS]", "  RX packets (NIC):   {rx_packets_nic}", "  RX dropped (HW):    \x1b[91m{rx_dropped}\x1b[0m (imissed)", "  RX no mbufs:        {rx_no_mbufs} (buffer exhaustion)", "  RX errors:          {rx_errors}",
    ),
    zero=True,
)
HTTP = Layout(
    title="HTTP FLOOD DETECTOR - STATISTICS",
    fields=(
        ("total_packets", "long", r"Total packets:\s+(\d+)"),
        ("http_packets", "long", r"HTTP packets:\s+(\d+)"),
        ("baseline_packets", "long", r"Baseline \([^)\n]*\):\s+(\d+)\s+\([\d.]+%\)"),
        ("baseline_percent", "double", r"Baseline \([^)\n]*\):\s+\d+\s+\(([\d.]+)%\)"),
        ("attack_packets", "long", r"Attack \([^)\n]*\):\s+(\d+)\s+\([\d.]+%\)"),
        ("attack_percent", "double", r"Attack \([^)\n]*\):\s+\d+\s+\(([\d.]+)%\)"),
        ("unique_ips", "long", r"Unique IPs:\s+(\d+)"),
        ("heavy_hitters", "long", r"Heavy hitters:\s+(\d+)"),
        ("get_count", "long", r"GET:\s+(\d+)\s+\([\d.]+%\)"),
        ("get_percent", "double", r"GET:\s+\d+\s+\(([\d.]+)%\)"),
        ("post_count", "long", r"POST:\s+(\d+)\s+\([\d.]+%\)"),
        ("post_percent", "double", r"POST:\s+\d+\s+\(([\d.]+)%\)"),
        ("top_url_count", "long", r"Top URL count:\s+(\d+)\s+\([\d.]+%\)"),
        ("top_url_percent", "double", r"Top URL count:\s+\d+\s+\(([\d.]+)%\)"),
        ("alert_level", "string", r"Alert level:\s+(\w+)"),
        ("alert_reason", "string", r"Reason:\s+(.+)"),
    ),
    lines=(
        "[PACKET COUNTERS]", "  Total packets:      {total_packets}", "  HTTP packets:       {http_packets}", "  Baseline ({net}): {baseline_packets} ({baseline_percent:.1f}%)", "  Attack ({net}): {attack_packets} ({attack_percent:.1f}%)", "",
        "[TRAFFIC ANALYSIS]", "  Unique IPs:         {unique_ips}", "  Heavy hitters:      {heavy_hitters}", "",
        "[HTTP METHODS]", "  GET:                {get_count} ({get_percent:.1f}%)", "  POST:               {post_count} ({post_percent:.1f}%)", "",
        "[URL CONCENTRATION]", "  Top URL:            /", "  Top URL count:      {top_url_count} ({top_url_percent:.1f}%)", "",
        "[ALERT STATUS]", "  Alert level:        \x1b[91m{alert_level}\x1b[0m", "  Reason:             {alert_reason}",
    ),
    needed="total_packets",
)
QUIC = Layout(
    title="QUIC OPTIMISTIC ACK DETECTOR - STATISTICS",
    fields=(
        ("total_packets", "long", r"Total packets:\s+(\d+)"),
        ("quic_packets", "long", r"QUIC packets:\s+(\d+)"),
        ("baseline_packets", "long", r"Baseline \([^)\n]*\):\s+(\d+)\s+\([\d.]+%\)"),
        ("baseline_percent", "double", r"Baseline \([^)\n]*\):\s+\d+\s+\(([\d.]+)%\)"),
        ("attack_packets", "long", r"Attack \([^)\n]*\):\s+(\d+)\s+\([\d.]+%\)"),
        ("attack_percent", "double", r"Attack \([^)\n]*\):\s+\d+\s+\(([\d.]+)%\)"),
        ("long_headers", "long", r"Long headers:\s+(\d+)"),
        ("short_headers", "long", r"Short headers:\s+(\d+)"),
        ("total_acks", "long", r"Total ACKs:\s+(\d+)"),
        ("bytes_in", "long", r"Bytes IN \(client\):\s+(\d+)"),
        ("bytes_out", "long", r"Bytes OUT \(server\):\s+(\d+)"),
        ("bytes_ratio", "double", r"Ratio OUT/IN:\s+([\d.]+)"),
        ("unique_ips", "long", r"Unique IPs:\s+(\d+)"),
        ("heavy_ackers", "long", r"Heavy ACKers:\s+(\d+)"),
        ("suspicious_ips", "long", r"Suspicious IPs:\s+(\d+)"),
        ("high_ack_rate_detections", "long", r"High ACK rate:\s+(\d+)"),
        ("bytes_anomalies", "long", r"Bytes anomalies:\s+(\d+)"),
        ("max_bytes_ratio", "double", r"Max bytes ratio:\s+([\d.]+)"),
        ("max_ack_rate", "long", r"Max ACK rate/IP:\s+(\d+)"),
        ("alert_level", "string", r"Alert level:\s+(\w+)"),
        ("alert_reason", "string", r"Reason:\s+(.+)"),
        ("amplification_at_detection", "double", r"Detected at:\s+([\d.]+)x amplification"),
        ("mb_at_detection", "double", r"Total bytes@detect:\s+([\d.]+)\s+MB"),
        ("cycles_per_packet", "double", r"Cycles/packet:\s+([\d.]+)\s+cycles"),
        ("throughput_per_core_gbps", "double", r"Throughput/core:\s+([\d.]+)\s+Gbps"),
    ),
    lines=(
        "[PACKET COUNTERS]", "  Total packets:      {total_packets}", "  QUIC packets:       {quic_packets}", "  Baseline ({net}): {baseline_packets} ({baseline_percent:.1f}%)", "  Attack ({net}): {attack_packets} ({attack_percent:.1f}%)", "",
        "[QUIC TRAFFIC ANALYSIS]", "  Long headers:       {long_headers} (handshakes)", "  Short headers:      {short_headers} (data)", "  Total ACKs:         {total_acks}", "",
        "[BYTES ANALYSIS]", "  Bytes IN (client):  {bytes_in}", "  Bytes OUT (server): {bytes_out}", "  Ratio OUT/IN:       {bytes_ratio:.2f}", "",
        "[IP ANALYSIS]", "  Unique IPs:         {unique_ips}", "  Heavy ACKers:       {heavy_ackers}", "  Suspicious IPs:     {suspicious_ips}", "",
        "[ATTACK INDICATORS]", "  High ACK rate:      {high_ack_rate_detections} detections", "  Bytes anomalies:    {bytes_anomalies} detections", "  Max bytes ratio:    {max_bytes_ratio:.2f}", "  Max ACK rate/IP:    {max_ack_rate}", "",
        "[ALERT STATUS]", "  Alert level:        \x1b[91m{alert_level}\x1b[0m", "  Reason:             {alert_reason}", "",
        "[AMPLIFICATION-BASED DETECTION]", "  Detected at:          {amplification_at_detection:.2f}x amplification", "  Total bytes@detect:   {mb_at_detection:.2f} MB", "",
        "[PERFORMANCE]", "  Cycles/packet:        {cycles_per_packet:.1f} cycles", "  Throughput/core:      {throughput_per_core_gbps:.2f} Gbps",
    ),
    needed="total_packets",
)
LAYOUTS = {"aggregate": AGGREGATE, "http": HTTP, "quic": QUIC}

#: What stands of the next block's box before its title.
_NEXT_BOX = r"\s*╔═+╗\s*\n║[^\n]*\z"


def blocks(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """file, split (its byte range), idx (from 0 in the file) and text of each block, colour codes removed.

    What stands before a file's first title is no block.
    """
    rows = spark.read.text(path, lineSep=layout.title).select("value", c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    inside = Window.partitionBy("file", "split").orderBy("row")
    rows = rows.withColumn("at", F.row_number().over(inside))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("file", "split").agg(F.count("*").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    text = F.regexp_replace(F.regexp_replace("value", COLOUR, ""), _NEXT_BOX, "")
    return rows.join(ranges, ["file", "split"]).select("file", "split", (c("before") + c("at") - 2).alias("idx"), text.alias("text")).where("idx >= 0")


def parse(found: DataFrame, layout: Layout) -> DataFrame:
    """Blocks with the fields of a layout in place of their text."""

    def field(name: str, kind: str, pattern: str) -> Column:
        value = F.nullif(F.regexp_replace(F.regexp_extract("text", pattern, 1), r"\s+\z", ""), F.lit(""))
        if kind == "string":
            return value
        value = value.try_cast(kind)
        return F.coalesce(value, F.lit(0).cast(kind)) if layout.zero else value

    out = found.select("file", "split", "idx", *[field(*f).alias(f[0]) for f in layout.fields])
    out = out.withColumns({"alert_level": F.upper(F.coalesce("alert_level", F.lit("NONE"))), "alert_reason": F.coalesce("alert_reason", F.lit("" if layout.zero else "None"))})
    return out.where(c(layout.needed) > 0) if layout.needed else out


def carry_first(rows: DataFrame, value: str) -> DataFrame:
    """Where ``value`` is 0 in a block, the first other value of its file, from the block that has it on."""
    first = rows.where(c(value) > 0).groupBy("file", "split").agg(F.min(F.struct("idx", value)).alias("own"))
    ranges = rows.select("file", "split").distinct().join(first, ["file", "split"], "left")
    upto = Window.partitionBy("file").orderBy("split")
    told = ranges.select("file", "split", F.min("own").over(upto).alias("first"))
    return rows.join(told, ["file", "split"]).withColumn(value, F.when((c(value) == 0) & (c("first.idx") <= c("idx")), c(f"first.{value}")).otherwise(c(value))).drop("first")


def read_log(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """A row for each block of the logs under a path: file, idx, time_s (since the file's start) and its fields.

    A block of the aggregate detector without a latency has the first one of its file.
    """
    rows = parse(blocks(spark, path, layout), layout)
    if "detection_latency_ms" in layout.columns:
        rows = carry_first(rows, "detection_latency_ms")
    return rows.withColumn("time_s", c("idx") * layout.interval_s).drop("split")


def render(rows: DataFrame, layout: Layout, net: str = "10.10") -> Column:
    """The text of a block; a line is left out where a figure in it is null."""
    told = set(rows.columns)

    def line(text: str) -> Column:
        parts = []
        for words, name, form, _ in string.Formatter().parse(text):
            parts.append(F.lit(words))
            if name == "net":
                parts.append(F.lit(net))
            elif name:
                value = c(name) if name in told else F.lit(None)
                parts.append(F.format_string(f"%{form}", value.cast("double")) if form else value.cast("string"))
                if form:
                    parts.append(F.when(value.isNotNull(), ""))
        return F.concat(*parts)

    top = [f"╔{'═' * 70}╗", f"║{layout.title:^70}║", f"╚{'═' * 70}╝", ""]
    return F.concat_ws("\n", *[F.lit(x) for x in top], *[line(x) for x in layout.lines], F.lit(""))


def write_log(rows: DataFrame, layout: Layout, path: str, log: str = "log", order: str = "idx", net: str = "10.10") -> None:
    """A text file for each value of ``log``, its blocks in order, under folders ``log=value``."""
    text = rows.select(c(log).alias("log"), c(order).alias("order_"), render(rows, layout, net).alias("value"))
    text.repartition("log").sortWithinPartitions("log", "order_").select("log", "value").write.partitionBy("log").text(path)
