"""Raw frames: packing and decoding of Ethernet, IPv4, TCP, UDP and ICMP headers, and a reader of capture files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidegate.functions import traffic as T
from tidegate.sources.packages import ship

c = F.col
ETHERTYPE_IPV4 = 0x0800


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def time_to_live() -> Column:
    """Of the fixtures: 64 less the hops of a source."""
    return 64 - F.pmod(c("src_ip"), F.lit(13))


def pack_frames(packets: DataFrame) -> DataFrame:
    """pkt_id, ts, pkt_len, frame: the headers of each packet as bytes."""
    zero = lambda n: F.lit("00" * n)
    port = lambda x: _hex(F.coalesce(c(x), F.lit(0)), 4)
    ethernet = F.concat(F.lit("02" * 6 + "04" * 6), F.lit("0800"))
    ip = F.concat(F.lit("4500"), _hex(c("pkt_len"), 4), zero(2), _hex(c("frag_off"), 4), _hex(time_to_live(), 2), _hex(c("proto"), 2), zero(2), _hex(c("src_ip"), 8), _hex(c("dst_ip"), 8))
    tcp = F.concat(port("src_port"), port("dst_port"), zero(8), F.lit("50"), _hex(F.coalesce("tcp_flags", F.lit(0)), 2), zero(6))
    udp = F.concat(port("src_port"), port("dst_port"), zero(4))
    body = F.when(c("proto") == T.TCP, tcp).when(c("proto") == T.UDP, udp).otherwise(zero(8))
    return packets.select("pkt_id", "ts", "pkt_len", F.unhex(F.concat(ethernet, ip, body)).alias("frame"))


def number_at(frame: Column, at: Column | int, size: int) -> Column:
    """An unsigned number of ``size`` bytes; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substr(frame, at + 1, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def decode_frames(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """``frames`` with the fields of the headers; null where a frame is too short or of another kind. The IPv4 header's length is read, not assumed."""
    b = c(frame)
    ip = number_at(b, 12, 2) == ETHERTYPE_IPV4
    rows = frames.withColumn("eth_type", number_at(b, 12, 2).cast("int")).withColumn("l4", F.when(ip, 14 + number_at(b, 14, 1).bitwiseAND(15) * 4).cast("int")).withColumn("proto", F.when(ip, number_at(b, 23, 1)).cast("int"))
    ports = c("proto").isin(T.TCP, T.UDP)
    return rows.withColumns({
        "frag_off": F.when(ip, number_at(b, 20, 2)).cast("int"), "ttl": F.when(ip, number_at(b, 22, 1)).cast("int"), "src_ip": F.when(ip, number_at(b, 26, 4)), "dst_ip": F.when(ip, number_at(b, 30, 4)),
        "src_port": F.when(ports, number_at(b, c("l4"), 2)).cast("int"), "dst_port": F.when(ports, number_at(b, c("l4") + 2, 2)).cast("int"),
        "tcp_flags": F.when(c("proto") == T.TCP, number_at(b, c("l4") + 13, 1)).cast("int"),
    }).drop("l4")


# Fixed values of the capture file format: magic numbers for microseconds and nanoseconds, header, record header.
PCAP_MAGIC, PCAP_MAGIC_NS, PCAP_HEAD, PCAP_RECORD = 0xA1B2C3D4, 0xA1B23C4D, "IHHiIII", "IIII"
#: Bytes read at a time, and packets of a batch.
READ_BYTES, BATCH_PACKETS = 1 << 20, 8192


def write_captures(frames: DataFrame, folder: str) -> DataFrame:
    """One capture file for each partition, in the shared folder; returns path and packets of the files.

    A file is written under another name and then moved to that of its partition, so a task that runs again replaces its own.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():05d}.pcap", 0
        attempt = f"{path}/_{name}-{uuid.uuid4().hex[:8]}"
        with store.open_output_stream(attempt, compression=None) as out:
            out.write(struct.pack("<" + PCAP_HEAD, PCAP_MAGIC, 2, 4, 0, 0, 65535, 1))
            for b in batches:
                for us, length, frame in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    out.write(struct.pack("<" + PCAP_RECORD, us // 1_000_000, us % 1_000_000, len(frame), length) + frame)
                    n += 1
        store.move(attempt, f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], ["path", "packets"])

    return frames.select(F.unix_micros(c("ts").cast("timestamp")).alias("us"), "pkt_len", "frame").mapInArrow(run, "path string, packets long")


def capture_files(folder: str) -> list[tuple[int, str]]:
    """(time of change in nanoseconds, path) of the files under a folder, in order; names that begin with _ or . are unfinished."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.is_file and f.base_name[0] not in "_.")


def capture_batches(folder: str, path: str) -> Iterator[pa.RecordBatch]:
    """The packets of a file: us, ns (nanoseconds after that), pkt_len, frame. Either byte order, either unit of time; a
    last record that is cut off is left out."""
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(folder)
    head, record = struct.calcsize("<" + PCAP_HEAD), struct.calcsize("<" + PCAP_RECORD)
    with store.open_input_stream(path, compression=None) as file:
        start = file.read(head)
        kinds = {struct.pack(order + "I", magic): (order, unit) for order in "<>" for magic, unit in ((PCAP_MAGIC, 1), (PCAP_MAGIC_NS, 1000))}
        if len(start) < head or start[:4] not in kinds:
            raise ValueError(f"{path} is no capture file")
        order, unit = kinds[start[:4]]
        one = struct.Struct(order + PCAP_RECORD)
        data, at, more = b"", 0, True
        us, ns, sizes, frames = [], [], [], []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(ns, pa.int32()), pa.array(sizes, pa.int32()), pa.array(frames, pa.binary())], ["us", "ns", "pkt_len", "frame"])
            for x in (us, ns, sizes, frames):
                x.clear()
            return out

        while True:
            if at + record > len(data) or at + record + one.unpack_from(data, at)[2] > len(data):
                got = file.read(READ_BYTES) if more else b""
                if not got:
                    break
                data, at = data[at:] + got, 0
                continue
            seconds, part, kept, length = one.unpack_from(data, at)
            us.append(seconds * 1_000_000 + part // unit)
            ns.append(part % unit)
            sizes.append(length)
            frames.append(data[at + record : at + record + kept])
            at += record + kept
            if len(us) == BATCH_PACKETS:
                yield batch()
        if us:
            yield batch()


class CapturePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CaptureReader(DataSourceReader):
    """A partition for each file of the folder: the format cannot be split."""

    def __init__(self, options):
        self.folder = options["path"]

    def partitions(self):
        return [CapturePartition(p) for _, p in capture_files(self.folder)]

    def read(self, partition):
        if partition is not None:
            yield from capture_batches(self.folder, partition.path)


class CaptureStreamReader(DataSourceStreamReader):
    """New files of the folder, in the order of their last change; the offset is that of the last file read."""

    def __init__(self, options):
        self.folder = options["path"]

    def initialOffset(self):
        return {"time": -1, "path": ""}

    def latestOffset(self):
        time, path = max(capture_files(self.folder), default=(-1, ""))
        return {"time": time, "path": path}

    def partitions(self, start, end):
        low, high = ((x["time"], x["path"]) for x in (start, end))
        return [CapturePartition(p) for t, p in capture_files(self.folder) if low < (t, p) <= high]

    def read(self, partition):
        yield from capture_batches(self.folder, partition.path)

    def commit(self, end):
        pass


class CaptureSource(DataSource):
    @classmethod
    def name(cls):
        return "captures"

    def schema(self):
        return "us long, ns int, pkt_len int, frame binary"

    def reader(self, schema):
        return CaptureReader(self.options)

    def streamReader(self, schema):
        return CaptureStreamReader(self.options)


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """The packets of all capture files under a folder."""
    ship(spark)
    spark.dataSource.register(CaptureSource)
    return spark.read.format("captures").load(folder)


def stream_captures(spark: SparkSession, folder: str) -> DataFrame:
    """The packets of capture files as they come into a folder."""
    ship(spark)
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("captures").load(folder)
