"""Reshaping, joins, labels, sources and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import labels, model, reshape
from trackloom.operators.single import meta_features
from trackloom.queries import views as v
from trackloom.sources import tables as io

c = F.col


def scan_pushdown(spark, sf_dir):
    """Predicate and projection that reach the Parquet scan."""
    df = v.table(spark, sf_dir, "lineitem").where((c("l_quantity") >= 45) & (c("l_returnflag") == "R"))
    return df.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def pivot_parts(spark, sf_dir):
    df = v.traj(spark, sf_dir).groupBy("entity", (c("frame") % 10).alias("slot"), "part").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    parts = ["click", "error", "purchase"]
    wide = reshape.pivot_parts(df, ["entity", "slot"], parts, "part")
    return v.rounded(wide, ["entity", "slot"], [f"{p}_{k}" for p in parts for k in "xy"])


def densify_frames(spark, sf_dir):
    df = v.traj(spark, sf_dir).select("entity", F.expr("frame + frame div 7").alias("frame"), "x")
    return v.rounded(reshape.densify(df, ["entity"]), ["entity", "frame"], ["x"])


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as videos: their JSON list of behaviours is made of the key."""
    k = c("c_custkey")
    cells = F.concat(F.lit('["mouse'), k % 3 + 1, F.lit(",self,rear\",\"mouse"), k % 2 + 1, F.lit(",mouse"), k % 4 + 1, F.lit(",'chase'\",\"mouse"), k % 3 + 1, F.lit(',self,rear"]'))
    lab = F.when(k % 5 == 0, F.concat(F.lit("MABe22_"), "c_mktsegment")).otherwise(c("c_mktsegment"))
    return v.table(spark, sf_dir, "customer").select(k.alias("video_id"), lab.alias("lab_id"), F.when(k % 7 != 0, cells).alias("behaviors_labeled"))


def usable_videos(spark, sf_dir):
    return reshape.usable_videos(_videos(spark, sf_dir)).groupBy("lab_id").agg(F.count(F.lit(1)).alias("n"))


def parse_behaviors(spark, sf_dir):
    return labels.parse_behaviours(_videos(spark, sf_dir).drop("lab_id"))


def parse_behaviors_all(spark, sf_dir):
    df = labels.parse_behaviours(_videos(spark, sf_dir).drop("lab_id"), distinct=False)
    return df.groupBy("agent", "target", "action").agg(F.count(F.lit(1)).alias("n"), F.sum(labels.mouse_number(c("agent"))).alias("agents"), F.sum(labels.mouse_number(c("target"))).alias("targets"))


def drop_redundant(spark, sf_dir):
    """Parts of a part's type: those that are redundant go where a brand has many."""
    p = v.table(spark, sf_dir, "part").select(c("p_brand").alias("video_id"), F.when(c("p_size") % 9 == 0, "spine_1").when(c("p_size") % 9 == 1, "tail_midpoint").otherwise(F.concat(F.lit("part"), c("p_size") % 9)).alias("bodypart"))
    return reshape.drop_redundant(p).groupBy("video_id", "bodypart").agg(F.count(F.lit(1)).alias("n"))


def section_numbers(spark, sf_dir):
    return reshape.sections(v.table(spark, sf_dir, "part").select(c("p_type").alias("body_parts_tracked"))).withColumn("section", c("section").cast("bigint"))


def count_mice(spark, sf_dir):
    df = v.table(spark, sf_dir, "customer").select("c_custkey", *(F.when(c("c_custkey") % k != 0, c("c_mktsegment")).alias(f"mouse{k}_strain") for k in (1, 2, 3, 4)))
    return df.groupBy(reshape.n_mice([f"mouse{k}_strain" for k in (1, 2, 3, 4)]).cast("bigint").alias("n_mice")).agg(F.count(F.lit(1)).alias("n"))


def pair_join(spark, sf_dir):
    made = reshape.pairs(v.with_video(v.poses(spark, sf_dir)), ["video"], "entity", "frame", ["tail_base_x", "tail_base_y"])
    return v.rounded(made, ["agent", "target", "frame"], ["A_tail_base_x", "B_tail_base_y"])


def group_centroid(spark, sf_dir):
    return v.rounded(reshape.group_centroid(v.traj(spark, sf_dir), []), ["frame"], ["group_x", "group_y"])


def metadata_join(spark, sf_dir):
    """Facts with a small dimension: Spark broadcasts it by its size."""
    e, n = v.table(spark, sf_dir, "supplier"), v.table(spark, sf_dir, "nation")
    return e.join(n, c("s_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s_acctbal"), 4).alias("mean_balance"))


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.traj(spark, sf_dir).where(c("part").isin("purchase", "error"))
    return df.select("entity", c("part").alias("action"), c("frame").alias("start_frame"), (c("frame") + 3).alias("stop_frame"))


def _labels(spark: SparkSession, sf_dir: str, inclusive: bool) -> DataFrame:
    frames = v.traj(spark, sf_dir).select("entity", "frame")
    labelled = frames.where(c("entity") % 3 != 0).select("entity").distinct().withColumn("action", F.lit("purchase"))
    return labels.label_frames(frames, _marks(spark, sf_dir), labelled, ["entity"], inclusive).withColumn("label", c("label").cast("int"))


def label_inclusive(spark, sf_dir):
    return _labels(spark, sf_dir, True)


def label_exclusive(spark, sf_dir):
    return _labels(spark, sf_dir, False)


def behavior_coverage(spark, sf_dir):
    e = v.traj(spark, sf_dir)
    expected = e.select("entity", "part").distinct()
    return labels.coverage(expected, e.where(c("x") > 250), ["entity", "part"])


def without_prediction(spark, sf_dir):
    o = v.table(spark, sf_dir, "orders").where(c("o_orderpriority") == "1-URGENT").select(c("o_custkey").alias("c_custkey"))
    return labels.without_prediction(v.table(spark, sf_dir, "customer"), o, "c_custkey").select("c_custkey", "c_name")


def row_numbers(spark, sf_dir):
    df = v.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return io.numbered(df, ["o_custkey", "o_orderkey"])


META_SQL_COLUMNS = {"frames_per_second": "p_size", "pix_per_cm_approx": "p_retailprice / 100", "video_width": "p_size * 20", "video_height": "p_size * 10", "arena_width_cm": "case when p_partkey % 9 = 0 then null else p_size end", "arena_height_cm": "p_size - 3", "n_mice": "p_partkey % 4 + 1"}
META_OUT = ["frames_per_second", "fps_log1p", "sec_per_frame", "cm_per_pix_approx", "log_pix_per_cm", "video_aspect", "video_area_px", "video_area_log1p", "video_diag_px", "arena_aspect", "arena_area_cm2", "arena_area_log1p", "arena_perimeter_cm", "arena_diag_cm", "n_mice_log1p", "n_mice_sq", "mice_density", "arena_area_per_mouse"]


def meta_onehot(spark, sf_dir):
    df = v.table(spark, sf_dir, "part").select("p_partkey", *(F.expr(e).cast("double").alias(n) for n, e in META_SQL_COLUMNS.items()), F.when(c("p_partkey") % 6 != 0, c("p_brand")).alias("lab_id"), *(F.lit(None).cast("string").alias(n) for n in ("arena_shape", "arena_type", "tracking_method")))
    made = meta_features(df, {"lab_id": ["Brand#11", "Brand#23"]})
    flags = ["lab_id=Brand#11", "lab_id=Brand#23", "lab_id=__UNK__", "lab_id=__NA__", "arena_type=__UNK__"]
    kept = made.select("p_partkey", *META_OUT, *(c(f"`{k}`").cast("int").alias(k) for k in flags))
    return kept.select("p_partkey", *(F.round(c(k).cast("double"), 2).alias(k) if k != "sec_per_frame" else F.round(c(k).cast("double"), 4).alias(k) for k in META_OUT), *(c(f"`{k}`") for k in flags))


def neg_sample(spark, sf_dir):
    """All positives and 2 negatives for each, by document source."""
    d = v.table(spark, sf_dir, "documents").select("doc_id", "source")
    df = v.table(spark, sf_dir, "labels").select("doc_id", c("toxic").alias("label")).join(d, "doc_id").select("doc_id", "source", "label")
    return model.sample_negatives(df, ["source"], share=2.0, floor=5)


def behavior_kinds(spark, sf_dir):
    """Behaviours of all videos by kind."""
    df = labels.parse_behaviours(_videos(spark, sf_dir).drop("lab_id"))
    both = [labels.of_kind(df, k).groupBy("action").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "action", "n") for k in ("self", "pair")]
    return both[0].unionByName(both[1])


def submitted_videos(spark, sf_dir):
    """Intervals of the users who have an error."""
    df = v.intervals(spark, sf_dir)
    return labels.of_videos(df, df.where("action = 'error' and start_frame < 10"), "entity").select("entity", "event_id", "start_frame")


def aligned_concat(spark, sf_dir):
    """Figures of the frames that have them, side by side."""
    df = v.traj(spark, sf_dir)
    parts = [df.where(c("part") == p).select("entity", "frame", c("x").alias(f"x_{p}")) for p in ("click", "error")]
    high = df.where("x > 200").select("entity", "frame", "y")
    return v.rounded(reshape.aligned([*parts, high], ["entity", "frame"]), ["entity", "frame"], ["x_click", "x_error", "y"])


def group_folds(spark, sf_dir):
    d = v.table(spark, sf_dir, "documents").select("doc_id", c("source").alias("video_id"))
    df = v.table(spark, sf_dir, "labels").select("doc_id", c("toxic").alias("label")).join(d, "doc_id")
    return model.assign_folds(df)


def gbt_oof(spark, sf_dir):
    """Out-of-fold probabilities of returned items."""
    df = v.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", (c("l_returnflag") == "R").cast("int").alias("label"), (c("l_orderkey") % 3).cast("int").alias("fold"))
    trees = model.Trees(trees=3, depth=3)
    out, _ = model.cross_validate(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], trees, folds=3)
    return out.select("l_orderkey", "l_linenumber", "label", "fold", "prediction")


NAMES = ("scan_pushdown", "pivot_parts", "densify_frames", "usable_videos", "parse_behaviors", "parse_behaviors_all", "drop_redundant", "section_numbers", "count_mice", "pair_join", "group_centroid", "metadata_join", "label_inclusive", "label_exclusive", "behavior_coverage", "without_prediction", "row_numbers", "meta_onehot", "behavior_kinds", "submitted_videos", "aligned_concat", "neg_sample", "group_folds", "gbt_oof")
QUERIES = {k: globals()[k] for k in NAMES}

VIDEO_SQL = """select c_custkey as video_id, case when c_custkey % 5 = 0 then 'MABe22_' || c_mktsegment else c_mktsegment end as lab_id,
    case when c_custkey % 7 <> 0 then ['mouse' || (c_custkey % 3 + 1) || ',self,rear', 'mouse' || (c_custkey % 2 + 1) || ',mouse' || (c_custkey % 4 + 1) || ',chase', 'mouse' || (c_custkey % 3 + 1) || ',self,rear'] end as cells from customer"""
CELLS = "split_part(cell, ',', 1) as agent, split_part(cell, ',', 2) as target, split_part(cell, ',', 3) as action"


def _label_sql(stop: str) -> str:
    return f"""with t as ({v.TRAJ_SQL}), hit as (select distinct entity, part as action, unnest(range(frame, frame + {stop})) as frame from t where part in ('purchase', 'error')),
        h as (select hit.* from hit semi join t on t.entity = hit.entity and t.frame = hit.frame), w as (select entity, frame, 'purchase' as action from t where entity % 3 <> 0)
        select entity, frame, action, cast(case when h.frame is null then 0 else 1 end as integer) as label from w full join h using (entity, frame, action)"""


def _meta_sql() -> str:
    base = ", ".join(f"({e})::double as {n}" for n, e in META_SQL_COLUMNS.items())
    up = ", ".join(f"case when {n} is not null then greatest({n}, 0) end as {a}" for n, a in (("frames_per_second", "fps"), ("pix_per_cm_approx", "ppc"), ("arena_width_cm", "aw"), ("arena_height_cm", "ah"), ("n_mice", "m")))
    e = {
        "frames_per_second": "frames_per_second", "fps_log1p": "ln(1 + fps)", "sec_per_frame": "1 / (fps + 1e-6)", "cm_per_pix_approx": "1 / (ppc + 1e-6)", "log_pix_per_cm": "ln(1 + ppc)",
        "video_aspect": "video_width / (video_height + 1e-6)", "video_area_px": "video_width * video_height", "video_area_log1p": "ln(1 + video_width * video_height)", "video_diag_px": "sqrt(video_width ** 2 + video_height ** 2)",
        "arena_aspect": "aw / (ah + 1e-6)", "arena_area_cm2": "aw * ah", "arena_area_log1p": "ln(1 + aw * ah)", "arena_perimeter_cm": "2 * (aw + ah)", "arena_diag_cm": "sqrt(aw * aw + ah * ah)",
        "n_mice_log1p": "ln(1 + m)", "n_mice_sq": "m * m", "mice_density": "m / (aw * ah + 1e-6)", "arena_area_per_mouse": "aw * ah / (m + 1e-6)",
    }
    cells = ", ".join(f'round(({x})::float::double, {4 if n == "sec_per_frame" else 2}) as "{n}"' for n, x in e.items())
    lab = "case when p_partkey % 6 <> 0 then p_brand end"
    flags = ", ".join(f"cast(case when coalesce({lab}, '') = '{b}' then 1 else 0 end as integer) as \"lab_id={b}\"" for b in ("Brand#11", "Brand#23"))
    return f"""with a as (select p_partkey, p_brand, {base} from part), b as (select *, {up} from a)
        select p_partkey, {cells}, {flags}, cast(case when coalesce({lab}, '') in ('Brand#11', 'Brand#23') then 0 else 1 end as integer) as "lab_id=__UNK__", cast(0 as integer) as "lab_id=__NA__", cast(1 as integer) as "arena_type=__UNK__" from b"""


ORACLE_SQL = {
    "scan_pushdown": "select l_linestatus, count(*) as n, round(sum(l_extendedprice), 2) as price from lineitem where l_quantity >= 45 and l_returnflag = 'R' group by 1",
    "pivot_parts": f"select entity, frame % 10 as slot, {', '.join(f'''round(max({k}) filter (where part = '{p}'), 4) + 0.0 as {p}_{k}''' for p in ('click', 'error', 'purchase') for k in 'xy')} from ({v.TRAJ_SQL}) group by 1, 2",
    "densify_frames": f"with t as (select entity, frame + frame // 7 as frame, x from ({v.TRAJ_SQL})), e as (select entity, unnest(range(min(frame), max(frame) + 1)) as frame from t group by entity) select entity, frame, round(x, 4) + 0.0 as x from e left join t using (entity, frame)",
    "usable_videos": f"select lab_id, count(*) as n from ({VIDEO_SQL}) where cells is not null and not starts_with(lab_id, 'MABe22') group by 1",
    "parse_behaviors": f"select video_id, {CELLS} from (select video_id, unnest(list_distinct(cells)) as cell from ({VIDEO_SQL}))",
    "parse_behaviors_all": f"select agent, target, action, count(*) as n, cast(sum(cast(substr(agent, 6) as integer)) as bigint) as agents, cast(sum(case when target <> 'self' then cast(substr(target, 6) as integer) end) as bigint) as targets from (select {CELLS} from (select unnest(cells) as cell from ({VIDEO_SQL}))) group by 1, 2, 3",
    "drop_redundant": """with p as (select p_brand as video_id, case p_size % 9 when 0 then 'spine_1' when 1 then 'tail_midpoint' else 'part' || (p_size % 9) end as bodypart from part), n as (select video_id, count(distinct bodypart) as k from p group by 1)
        select video_id, bodypart, count(*) as n from p join n using (video_id) where k <= 5 or bodypart not in ('spine_1', 'tail_midpoint') group by 1, 2""",
    "section_numbers": "select p_type as body_parts_tracked, row_number() over (order by p_type) - 1 as section from (select distinct p_type from part)",
    "count_mice": "select cast(0 + (c_custkey % 2 <> 0)::int + (c_custkey % 3 <> 0)::int + (c_custkey % 4 <> 0)::int as bigint) as n_mice, count(*) as n from customer group by 1",
    "pair_join": f"""select a.entity as agent, b.entity as target, frame, round(a.tail_base_x, 4) + 0.0 as "A_tail_base_x", round(b.tail_base_y, 4) + 0.0 as "B_tail_base_y" from ({v.POSE_SQL}) a join ({v.POSE_SQL}) b using (frame) where a.entity <> b.entity and a.entity // {v.MICE} = b.entity // {v.MICE}""",
    "group_centroid": f"select frame, round(avg(x), 4) + 0.0 as group_x, round(avg(y), 4) + 0.0 as group_y from ({v.TRAJ_SQL}) group by frame",
    "metadata_join": "select n_name, count(*) as n, round(avg(s_acctbal), 4) as mean_balance from supplier join nation on s_nationkey = n_nationkey group by 1",
    "label_inclusive": _label_sql("4"),
    "label_exclusive": _label_sql("3"),
    "behavior_coverage": f"with t as ({v.TRAJ_SQL}) select distinct entity, part from t except select entity, part from t where x > 250",
    "without_prediction": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "row_numbers": "select row_number() over (order by o_custkey, o_orderkey) - 1 as row_id, o_orderkey, o_custkey from orders",
    "meta_onehot": _meta_sql(),
    "behavior_kinds": f"select case action when 'rear' then 'self' else 'pair' end as kind, action, count(*) as n from (select video_id, {CELLS} from (select video_id, unnest(list_distinct(cells)) as cell from ({VIDEO_SQL}))) group by 1, 2",
    "submitted_videos": f"select entity, event_id, start_frame from ({v.INTERVAL_SQL}) where entity in (select entity from ({v.INTERVAL_SQL}) where action = 'error' and start_frame < 10)",
    "aligned_concat": f"with t as ({v.TRAJ_SQL}) select entity, frame, round(case when part = 'click' then x end, 4) + 0.0 as x_click, round(case when part = 'error' then x end, 4) + 0.0 as x_error, round(case when x > 200 then y end, 4) + 0.0 as y from t where part in ('click', 'error') or x > 200",
    "neg_sample": """with d as (select l.doc_id, d.source, l.toxic as label from labels l join documents d using (doc_id)), p as (select *, sum(label) over (partition by source) as pos,
        row_number() over (partition by source, label order by md5(concat_ws('|', '42', coalesce(doc_id::varchar, ''), coalesce(source, ''), coalesce(label::varchar, '')))) as nth from d where source is not null)
        select doc_id, source, label from p where pos > 0 and (label = 1 or nth <= greatest(2.0 * pos, 5))""",
}
