"""Scores, labels, models and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import traffic as T
from tidegate.operators import counters as K
from tidegate.operators import models as M
from tidegate.plans.registry import query
from tidegate.sources.storage import scratch
from tidegate.sources.tables import packets, sql

c = F.col
DAY = "1 day"


def daily(spark, sf):
    return K.window_counters(packets(spark, sf), DAY)


@query("ml_signatures", sql("SELECT round(avg(CASE WHEN syn > 0.34 * tcp THEN 1.0::DOUBLE ELSE 0 END), 6) AS syn_share, round(avg(CASE WHEN udp > 0.2 * packets THEN 1.0::DOUBLE ELSE 0 END), 6) AS udp_share, count(*) AS windows FROM counters", "counters"))
def ml_signatures(spark, sf):
    share = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 6)
    return daily(spark, sf).agg(share(c("syn") > 0.34 * c("tcp")).alias("syn_share"), share(c("udp") > 0.2 * c("packets")).alias("udp_share"), F.count("*").alias("windows"))


Z = "(" + "{x} - avg({x}) OVER ()) / (stddev_pop({x}) OVER () + 1e-8)"
SCORES = "(SELECT w, " + ", ".join(f"({x} - avg({x}) OVER ()) / (stddev_pop({x}) OVER () + 1e-8) AS {x}_z" for x in ("bytes", "packets", "syn", "udp")) + " FROM counters) z"
SCORE = "least(1.0::DOUBLE, CASE WHEN bytes_z > 2 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN packets_z > 2 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN syn_z > 1.5 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN udp_z > 1.5 THEN 0.25::DOUBLE ELSE 0 END)"


def scored(spark, sf):
    rows = M.zscores(daily(spark, sf), {x: f"{x}_z" for x in ("bytes", "packets", "syn", "udp")})
    return rows.withColumn("score", M.rule_score(c("bytes_z"), c("packets_z"), c("syn_z"), c("udp_z")))


@query("ml_rule_score", sql(f"SELECT w, round({SCORE}, 6) AS score FROM {SCORES}", "counters"))
def ml_rule_score(spark, sf):
    return scored(spark, sf).select("w", F.round("score", 6).alias("score"))


@query("ml_predict_binary", sql(f"SELECT w, {SCORE} >= 0.3 AS attack FROM {SCORES}", "counters"))
def ml_predict_binary(spark, sf):
    return scored(spark, sf).select("w", (c("score") >= 0.3).alias("attack"))


@query("ml_attack_labels", sql("SELECT w, CASE WHEN l = '' THEN 'NORMAL' ELSE l END AS labels FROM (SELECT w, concat_ws('|', CASE WHEN syn > 0.34 * tcp THEN 'SYN_FLOOD' END, CASE WHEN udp > 0.2 * packets THEN 'UDP_FLOOD' END, CASE WHEN frag > 0.1 * packets THEN 'FRAGMENTATION' END) AS l FROM counters) s", "counters"))
def ml_attack_labels(spark, sf):
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return daily(spark, sf).select("w", M.attack_labels(flag(c("syn") > 0.34 * c("tcp")), flag(c("udp") > 0.2 * c("packets")), flag(c("frag") > 0.1 * c("packets")), (0.5, 0.5, 0.5)).alias("labels"))


@query("ml_batch_summary", sql(f"SELECT count(*) AS n, CAST(count(*) FILTER (WHERE s >= 0.3) AS BIGINT) AS attacks, round(max(s), 6) AS max_score, round(avg(s), 6) AS mean_score FROM (SELECT {SCORE} AS s FROM {SCORES}) q", "counters"))
def ml_batch_summary(spark, sf):
    return scored(spark, sf).agg(F.count("*").alias("n"), T.count_where(c("score") >= 0.3).alias("attacks"), F.round(F.max("score"), 6).alias("max_score"), F.round(F.avg("score"), 6).alias("mean_score"))


BUILD = """SELECT w, packets AS total_packets, bytes AS total_bytes, udp AS udp_packets, tcp AS tcp_packets, icmp AS icmp_packets, syn AS syn_packets, http AS http_requests, baseline AS baseline_packets, attack AS attack_packets,
  round(CASE WHEN tcp > 0 THEN udp / tcp::DOUBLE ELSE udp END, 6) AS udp_tcp_ratio, round(CASE WHEN packets > 0 THEN syn / packets::DOUBLE ELSE 0 END, 6) AS syn_total_ratio,
  round(CASE WHEN attack > 0 THEN baseline / attack::DOUBLE ELSE baseline END, 6) AS baseline_attack_ratio, round(CASE WHEN packets > 0 THEN bytes / packets::DOUBLE ELSE 0 END, 6) AS bytes_per_packet FROM counters"""


@query("ml_build_13", sql(BUILD, "counters"))
def ml_build_13(spark, sf):
    return M.model_features(daily(spark, sf))


@query("ml_split", sql("SELECT pkt_id, CASE WHEN (pkt_id * 7919 + 13) % 100 < 70 THEN 'train' WHEN (pkt_id * 7919 + 13) % 100 < 85 THEN 'validate' ELSE 'test' END AS split FROM packets"))
def ml_split(spark, sf):
    return M.split(packets(spark, sf), "pkt_id").select("pkt_id", "split")


LABELLED = "(SELECT pkt_id, CASE WHEN net = 'attack' AND proto = 17 THEN 'udp_flood' WHEN net = 'attack' AND tcp_flags & 2 <> 0 THEN 'syn_flood' WHEN net = 'attack' AND proto = 1 THEN 'icmp_flood' WHEN net = 'attack' THEN 'mixed_attack' ELSE 'benign' END AS label FROM packets) l"


def labelled(spark, sf):
    attack = T.network_class(c("src_ip")) == "attack"
    label = F.when(attack & (c("proto") == T.UDP), "udp_flood").when(attack & T.has_flag(c("tcp_flags"), T.SYN), "syn_flood").when(attack & (c("proto") == T.ICMP), "icmp_flood").when(attack, "mixed_attack").otherwise("benign")
    return packets(spark, sf).withColumn("label", label)


@query("ml_label_index", sql(f"SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS idx, n FROM (SELECT label, count(*) AS n FROM {LABELLED} GROUP BY label) s"))
def ml_label_index(spark, sf):
    """Counts by the index that a mapping file, written first, gives each label."""
    from pyspark.ml.feature import StringIndexer

    rows, path = labelled(spark, sf).groupBy("label").agg(F.count("*").alias("n")), scratch(spark, "label-index")
    found = StringIndexer(inputCol="label", outputCol="i", stringOrderType="alphabetAsc").fit(rows).labels
    spark.createDataFrame(list(enumerate(found)), "idx long, label string").write.json(path)
    return rows.join(F.broadcast(spark.read.schema("idx long, label string").json(path)), "label").select("label", "idx", "n")


#: Rows of the multiclass model: a day of a quarter of a network's sources. Features are counted over its packets of even
#: number, and the label over those of odd number (the kind with most packets; mixed where the first two are next to each
#: other), so the label does not follow from the features.
ROWS_SQL = """, rows AS (SELECT *, CASE WHEN net <> 'attack' THEN 'benign' WHEN udp + syn + icmp - least(udp, syn, icmp) >= 2 * greatest(udp, syn, icmp) - 1 THEN 'mixed_attack' WHEN udp = greatest(udp, syn, icmp) THEN 'udp_flood' WHEN syn = greatest(udp, syn, icmp) THEN 'syn_flood' ELSE 'icmp_flood' END AS label,
  ((epoch_us(strptime(w, '%Y-%m-%d %H:%M:%S')) // 86400000000 * 8 + CASE WHEN net = 'attack' THEN 4 ELSE 0 END + part) * 7919 + 13) % 100 AS luck FROM (SELECT w, net, src_ip % 4 AS part, count(*) FILTER (WHERE pkt_id % 2 = 0) AS seen, count(*) FILTER (WHERE pkt_id % 2 = 1) AS n,
  count(*) FILTER (WHERE pkt_id % 2 = 1 AND proto = 17) AS udp, count(*) FILTER (WHERE pkt_id % 2 = 1 AND tcp_flags & 2 <> 0) AS syn, count(*) FILTER (WHERE pkt_id % 2 = 1 AND proto = 1) AS icmp FROM packets GROUP BY 1, 2, 3) x WHERE seen > 0 AND n > 0)
"""


def rows_sql(body: str) -> str:
    return sql("", "packets").rstrip() + ROWS_SQL + body


def model_rows(spark, sf):
    """w (the name of the row), label, split and the features of the multiclass model."""
    p = packets(spark, sf).withColumns({"net": T.network_class(c("src_ip")), "part": c("src_ip") % 4})
    named = lambda rows: rows.withColumn("day", c("w")).withColumn("w", F.concat_ws(" ", "w", "net", c("part").cast("string")))
    features = M.model_features(named(K.window_counters(p.where(c("pkt_id") % 2 == 0), DAY, ("net", "part"))))
    told = named(K.window_counters(p.where(c("pkt_id") % 2 == 1), DAY, ("net", "part"), only=("udp", "syn", "icmp")))
    most = F.greatest("udp", "syn", "icmp")
    label = F.when(c("net") != "attack", "benign").when(c("udp") + c("syn") + c("icmp") - F.least("udp", "syn", "icmp") >= 2 * most - 1, "mixed_attack").when(c("udp") == most, "udp_flood").when(c("syn") == most, "syn_flood").otherwise("icmp_flood")
    number = F.unix_date(F.to_date("day", "yyyy-MM-dd HH:mm:ss")).cast("long") * 8 + F.when(c("net") == "attack", 4).otherwise(0) + c("part")
    told = told.select("w", "day", "net", "part", label.alias("label"), number.alias("number"))
    return M.split(features.join(told, "w"), "number")


def held_out_accuracy(scored_rows):
    """One row: accuracy, and the share of the most frequent label."""
    counts = scored_rows.groupBy("label").agg(F.count("*").alias("n"), T.count_where(c("label") == c("predicted")).alias("right"))
    return counts.agg((F.sum("right") / F.sum("n")).alias("accuracy"), (F.max("n") / F.sum("n")).alias("majority"))


@query("ml_train_multiclass", rows_sql("SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS idx, 100 AS trees, CAST(count(*) FILTER (WHERE luck >= 70) AS BIGINT) AS tested, true AS over_majority, true AS under_one FROM rows GROUP BY label"))
def ml_train_multiclass(spark, sf):
    """A forest of 100 trees over the 13 features, saved with its label mapping and loaded again, on the rows held out:
    it is right at least as often as the most frequent label, and not always, since labels are drawn from other packets."""
    rows, path = model_rows(spark, sf), scratch(spark, "multiclass")
    # Labels are known from all rows, trees from the training rows.
    M.save_model(M.train_multiclass(rows.where("split = 'train'"), "label", M.FEATURES, labels=rows), path, spark)
    model, labels = M.load_model(path, spark)
    known = F.broadcast(spark.createDataFrame(list(enumerate(labels)), "idx int, label string"))
    scored_rows = M.score_multiclass(model, rows.where("split <> 'train'"), "label")
    one = held_out_accuracy(scored_rows).select((c("accuracy") >= c("majority")).alias("over_majority"), (c("accuracy") < 1).alias("under_one"))
    tested = scored_rows.groupBy("label").agg(F.count("*").alias("tested"))
    return known.join(tested, "label", "left").crossJoin(F.broadcast(one)).select("label", "idx", F.lit(model.stages[-1].getNumTrees).cast("int").alias("trees"), F.coalesce("tested", F.lit(0)).alias("tested"), "over_majority", "under_one")


@query("ml_score_multiclass", rows_sql("SELECT w, net, CAST(part AS BIGINT) AS part, label, CAST((SELECT count(DISTINCT label) FROM rows) AS INT) AS classes, 1.0::DOUBLE AS total, true AS first_is_most FROM rows WHERE luck >= 70"))
def ml_score_multiclass(spark, sf):
    """Predictions with the probabilities of all classes: they sum to one, and the confidence is the greatest."""
    rows = model_rows(spark, sf)
    model = M.train_multiclass(rows.where("split = 'train'"), "label", M.FEATURES, labels=rows)
    scored_rows = M.score_multiclass(model, rows.where("split <> 'train'"), "label")
    total = F.round(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x), 6)
    return scored_rows.select(c("day").alias("w"), "net", "part", "label", F.size("probabilities").alias("classes"), total.alias("total"), ((c("confidence") == F.array_max("probabilities")) & (c("confidence") >= 1 / F.size("probabilities"))).alias("first_is_most"))


#: Predictions to evaluate: the label itself but for one packet in seven.
PREDICTED = f"(SELECT label, CASE WHEN pkt_id % 7 = 0 THEN 'benign' ELSE label END AS predicted FROM {LABELLED}) p"


@query("ml_evaluate", sql(f"SELECT l.label, round(CASE WHEN np > 0 THEN tp / np::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN nl > 0 THEN tp / nl::DOUBLE ELSE 0 END, 6) AS recall, (SELECT round(avg(CASE WHEN predicted = label THEN 1.0::DOUBLE ELSE 0 END), 6) FROM {PREDICTED}) AS accuracy FROM (SELECT label, count(*) AS nl, count(*) FILTER (WHERE predicted = label) AS tp FROM {PREDICTED} GROUP BY label) l LEFT JOIN (SELECT predicted, count(*) AS np FROM {PREDICTED} GROUP BY predicted) q ON q.predicted = l.label"))
def ml_evaluate(spark, sf):
    pairs = labelled(spark, sf).select("label", F.when(c("pkt_id") % 7 == 0, "benign").otherwise(c("label")).alias("predicted")).groupBy("label", "predicted").agg(F.count("*").alias("n"))
    real = pairs.groupBy("label").agg(F.sum("n").alias("nl"), F.sum(F.when(c("label") == c("predicted"), c("n")).otherwise(0)).alias("tp"))
    said = pairs.groupBy(c("predicted").alias("label")).agg(F.sum("n").alias("np"))
    whole = F.broadcast(real.agg(F.round(F.sum("tp") / F.sum("nl"), 6).alias("accuracy")))  # one row
    return real.join(said, "label", "left").crossJoin(whole).select("label", T.ratio(c("tp"), F.coalesce("np", F.lit(0))).alias("precision"), T.ratio(c("tp"), c("nl")).alias("recall"), "accuracy")


#: Features of a packet for the gate: its network, and its service port among those of the documented services. Kinds of
#: attack share ports, so the label does not follow from them.
GATE_PORTS = (22, 53, 80, 123, 161, 443, 8080, 8443)
#: Laplace-smoothed shares of the training packets, as naive Bayes counts them: two of 11 indicators stand in each row.
GATE_SQL = f""", seen AS (SELECT p.pkt_id, p.w, l.label, p.net = 'attack' AS hostile, CASE WHEN p.dst_port IN {GATE_PORTS} THEN p.dst_port ELSE 0 END AS port, (p.pkt_id * 7919 + 13) % 100 < 70 AS learned FROM packets p JOIN {LABELLED} ON l.pkt_id = p.pkt_id),
kinds AS (SELECT label, count(*) AS n FROM seen WHERE learned GROUP BY label), whole AS (SELECT sum(n) AS n, count(*) AS kinds FROM kinds),
nets AS (SELECT label, hostile, count(*) AS n FROM seen WHERE learned GROUP BY ALL), ports AS (SELECT label, port, count(*) AS n FROM seen WHERE learned GROUP BY ALL),
weights AS (SELECT c.hostile, c.port, k.label, (k.n + 1.0::DOUBLE) / (whole.n + whole.kinds) * (coalesce(x.n, 0) + 1) / (2 * k.n + 11) * (coalesce(y.n, 0) + 1) / (2 * k.n + 11) AS p
  FROM (SELECT DISTINCT hostile, port FROM seen) c CROSS JOIN kinds k CROSS JOIN whole LEFT JOIN nets x ON x.label = k.label AND x.hostile = c.hostile LEFT JOIN ports y ON y.label = k.label AND y.port = c.port),
told AS (SELECT hostile, port, label AS predicted, p / sum(p) OVER (PARTITION BY hostile, port) AS confidence, row_number() OVER (PARTITION BY hostile, port ORDER BY p DESC, label) AS place FROM weights),
gate AS (SELECT s.pkt_id, s.w, t.predicted, t.confidence, t.predicted <> 'benign' AND t.confidence >= 0.75 AS attack FROM seen s JOIN told t ON t.hostile = s.hostile AND t.port = s.port AND t.place = 1)
"""


def gate_sql(body: str, *names: str) -> str:
    return sql("", *names).rstrip() + GATE_SQL + body


def predictions(spark, sf):
    """All packets (pkt_id, w) with the class and confidence that naive Bayes gives them, which learned from the training
    packets, and whether they pass the gate."""
    rows = M.split(labelled(spark, sf), "pkt_id")
    net, port = T.network_class(c("src_ip")), c("dst_port")
    known = F.coalesce(port.isin(*GATE_PORTS), F.lit(False))
    told = {"hostile": net == "attack", "peaceful": net != "attack", **{f"port_{x}": known & (port == x) for x in GATE_PORTS}, "port_none": ~known}
    rows = rows.withColumns({name: F.coalesce(cond.cast("int"), F.lit(0)) for name, cond in told.items()})
    model = M.train_multiclass(rows.where("split = 'train'"), "label", tuple(told), kind="bayes")
    model.stages[0].setHandleInvalid("keep")  # no packet goes for a label that no training packet has
    day = F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd HH:mm:ss")
    return M.score_multiclass(model, rows.select("pkt_id", day.alias("w"), "label", *told), "label").withColumn("attack", M.gated(c("predicted"), c("confidence")))


@query("ml_confidence_gate", gate_sql("SELECT pkt_id, predicted, round(confidence, 6) AS confidence, attack FROM gate"))
def ml_confidence_gate(spark, sf):
    """Every packet with its class, and whether it is an attack of at least the confidence."""
    return predictions(spark, sf).select("pkt_id", "predicted", F.round("confidence", 6).alias("confidence"), "attack")


@query("ml_hybrid_decision", gate_sql("SELECT w, CASE WHEN syn > 0.34 * tcp AND passed * 20 > packets * 3 THEN 'CRITICAL' WHEN syn > 0.34 * tcp THEN 'HIGH' WHEN passed * 20 > packets * 3 THEN 'ANOMALY' ELSE 'NONE' END AS decision FROM counters JOIN (SELECT w, count(*) FILTER (WHERE attack) AS passed FROM gate GROUP BY w) g USING (w)", "counters"))
def ml_hybrid_decision(spark, sf):
    """The decision of every day: the rule on SYN packets, and the model where more than 15 % of the packets pass its gate."""
    model = predictions(spark, sf).groupBy("w").agg((T.count_where(c("attack")) * 20 > F.count("*") * 3).alias("model"))
    return daily(spark, sf).join(model, "w").select("w", M.hybrid_decision(c("syn") > 0.34 * c("tcp"), c("model")).alias("decision"))


class BrokenModel:
    def predict_proba(self, rows):
        raise RuntimeError("no such model")


@query("ml_model_fallback", sql(f"SELECT w, round({SCORE}, 6) AS without_model, round({SCORE}, 6) AS broken_model, round(attack / packets::DOUBLE, 6) AS with_model FROM {SCORES} JOIN (SELECT w, attack, packets FROM counters) k USING (w)", "counters"))
def ml_model_fallback(spark, sf):
    """The score without a model, with one that fails, and with one that works."""
    rows = M.zscores(daily(spark, sf), {x: f"{x}_z" for x in ("bytes", "packets", "syn", "udp")})
    rule = lambda _: M.rule_score(c("bytes_z"), c("packets_z"), c("syn_z"), c("udp_z"))
    models = {"without_model": None, "broken_model": BrokenModel(), "with_model": M.ShareModel("attack", "packets")}
    out = rows.select("w")
    for name, model in models.items():
        out = out.join(M.score_with(model, rows, ("attack", "packets"), rule).select("w", F.round("score", 6).alias(name)), "w")
    return out
