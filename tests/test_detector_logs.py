"""Detector logs in the detectors' own forms: colours, labels of any subnet, missing parts, large files read in ranges."""

import pytest
from pyspark.sql import functions as F

from tidegate.sources import detector_logs as D

BOX = "╔" + "═" * 70 + "╗\n║{:^70}║\n╚" + "═" * 70 + "╝\n\n"
AGG = BOX.format("ANY DDoS DETECTOR - STATISTICS")
HTTP = BOX.format("HTTP FLOOD DETECTOR - STATISTICS")
QUIC = BOX.format("QUIC OPTIMISTIC ACK DETECTOR - STATISTICS")


def read(spark, tmp_path, text, layout, name="a.log"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return [r.asDict() for r in D.read_log(spark, str(tmp_path), layout).orderBy("file", "idx").collect()]


def test_aggregate_block(spark, tmp_path):
    block = """[PACKET COUNTERS]
  Total packets:      350154358
  Baseline (192.168.1): 233437470 (66.7%)
  Attack (192.168.2): 116716888 (33.3%)
  TCP packets:        258923999

[INSTANTANEOUS TRAFFIC - Last 5.0 seconds]
  Baseline (192.168.1): 4391374 pkts (21.1%)  256177122 bytes  0.41 Gbps
  Attack (192.168.2): 16396926 pkts (78.9%)  6277141330 bytes  10.04 Gbps
  Total throughput:   \x1b[92m10.45 Gbps\x1b[0m  (avg pkt: 314 bytes)

[CUMULATIVE TRAFFIC - Since first packet (30.4s)]
  Total received:     350154358 pkts (11.52 Mpps) | 18.48 Gbps | 70221142653 bytes

  SYN-ACK packets:    21813879
  SYN/ACK ratio:      4.98
[ALERT STATUS]
  Alert level:        \x1b[91mhigh\x1b[0m
  Reason:             UDP FLOOD detected: 14807701 UDP pps |
  SYN FLOOD
[OTHER]
  First Detection Latency:   48.68 ms (literature: 866 ms)
    Improvement:             17.8× faster
  Total sketch memory:       5377 KB (14 workers × 384.1 KB)
  Sampling rate:             1 in 32 packets (3.1% overhead)
  Throughput:         10.45 Gbps (4.16 Mpps)
  RX dropped (HW):    \x1b[91m12\x1b[0m (imissed)
"""
    text = "Starting, Total packets: 9\n" + AGG + "  Total packets:      5\n" + AGG + block + AGG + "[ALERT STATUS]\n  Alert level: NONE\n"
    none, got, last = read(spark, tmp_path, text, D.AGGREGATE)
    assert (none["idx"], none["time_s"], none["total_packets"], none["alert_level"], none["alert_reason"], none["detection_latency_ms"], none["syn_ack_ratio"]) == (0, 0, 5, "NONE", "", 0, 0)
    want = {"idx": 1, "time_s": 5, "total_packets": 350154358, "baseline_packets": 233437470, "baseline_percent": 66.7, "attack_percent": 33.3, "baseline_gbps": 0.41, "attack_gbps": 10.04, "total_gbps": 10.45, "cumulative_mpps": 11.52, "cumulative_gbps": 18.48, "syn_ack_packets": 21813879, "syn_packets": 0, "syn_ack_ratio": 4.98,
            "alert_level": "HIGH", "alert_reason": "UDP FLOOD detected: 14807701 UDP pps |\n  SYN FLOOD", "detection_latency_ms": 48.68, "improvement_factor": 17.8, "sketch_memory_kb": 5377.0, "sketch_sampling_rate": 32, "throughput_mpps": 4.16, "rx_dropped": 12}
    assert {k: got[k] for k in want} == want
    assert (last["idx"], last["total_packets"], last["detection_latency_ms"], last["improvement_factor"], last["alert_reason"]) == (2, 0, 48.68, 0, "")


def test_http_and_quic_blocks(spark, tmp_path):
    for d in ("h", "q"):
        (tmp_path / d).mkdir()
    http = HTTP + "  HTTP packets:       7\n" + HTTP + "  Total packets:      10\n  Attack (203.0.113): 3 (31.9%)\n  GET:                8 (78.6%)\n  Top URL count:      130006 (0.2%)\n  Alert level:        LOW\n  Reason:             one reason | two\n\nmore\n" + HTTP + "  Total packets:      0\n"
    (got,) = read(spark, tmp_path / "h", http, D.HTTP)
    assert (got["idx"], got["time_s"], got["total_packets"], got["attack_packets"], got["attack_percent"], got["get_count"], got["get_percent"], got["top_url_percent"], got["alert_reason"], got["baseline_packets"]) == (1, 5, 10, 3, 31.9, 8, 78.6, 0.2, "one reason | two", None)
    quic = QUIC + "  Total packets:      10\n  Total ACKs:         4\n  Bytes OUT (server): 900\n  Ratio OUT/IN:       2.25\n  Max ACK rate/IP:    33\n  Alert level:        \x1b[1;91mCRITICAL\x1b[0m\n  Detected at:          2.31x amplification\n  Total bytes@detect:   1.50 MB\n"
    (got,) = read(spark, tmp_path / "q", quic, D.QUIC)
    assert (got["total_acks"], got["bytes_out"], got["bytes_ratio"], got["max_ack_rate"], got["alert_level"], got["amplification_at_detection"], got["mb_at_detection"], got["alert_reason"]) == (4, 900, 2.25, 33, "CRITICAL", 2.31, 1.5, "None")


def test_no_blocks(spark, tmp_path):
    assert read(spark, tmp_path, "", D.AGGREGATE) == [] and read(spark, tmp_path, "no banner\n" * 5, D.AGGREGATE) == []


@pytest.mark.parametrize("size", ["1k", "777", "64m"])
def test_ranges(spark, tmp_path, size):
    """One large file among others is read by several tasks; blocks are numbered and inherit along the whole file."""
    blocks = [AGG + f"  Total packets:      {i}\n" + "filler é\n" * (i % 40) + (f"  First Detection Latency:   {i}.50 ms\n" if i in (150, 200) else "") for i in range(300)]
    (tmp_path / "big.log").write_text("head\n" + "".join(blocks), encoding="utf-8")
    (tmp_path / "small.log").write_text("".join(blocks[:2]), encoding="utf-8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        splits = D.blocks(spark, str(tmp_path), D.AGGREGATE).where(F.contains("file", F.lit("big"))).select("split").distinct().count()
        got = D.read_log(spark, str(tmp_path), D.AGGREGATE).select("file", "idx", "total_packets", "detection_latency_ms").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert splits > 30 if size != "64m" else splits == 1
    big = sorted((r["idx"], r["total_packets"], r["detection_latency_ms"]) for r in got if "big" in r["file"])
    assert big == [(i, i, 0 if i < 150 else 200.5 if i == 200 else 150.5) for i in range(300)]
    assert sorted((r["idx"], r["total_packets"]) for r in got if "small" in r["file"]) == [(0, 0), (1, 1)]
