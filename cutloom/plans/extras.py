"""Merging, picking and registry queries."""

from pyspark.sql import functions as F

from cutloom.operators import masks as M
from cutloom.operators import outline as O
from cutloom.operators import raster as R
from cutloom.operators import speech as S
from cutloom.plans.geometry import LISTS, visvalingam_sql
from cutloom.sources import adapters as A
from cutloom.tables import spread

PX = ["px", "py"]


def _merged(s, d):
    """Masks of three prompts in turn; a later prompt overwrites the same pixel and object."""
    e = A.read(s, d, "events").select(F.col("user_id").alias("px"), (F.col("event_id") % 7).alias("py"), F.col("event_type").alias("obj"), (F.col("event_id") % 3).alias("prompt"), "event_id", "value")
    return M.merge_prompts(e, [*PX, "obj"], ["prompt", "event_id"], "value")


def _picks(s, d):
    """Frames to show around a prompt frame, without repeats, in order."""
    p = A.read(s, d, "part").select("p_partkey", (F.col("p_partkey") % 200).alias("prompt"), (F.lit(60) + F.col("p_size")).alias("n"))
    return p.select("p_partkey", F.posexplode(M.frames_to_show(F.col("prompt"), F.col("n"))).alias("k", "frame"))


def _objects(s, d):
    p = A.presence(s, d).filter("v > 0.5")
    e = M.encode(A.presence(s, d), PX, 5)
    codes = e.groupBy("py").agg(F.count_distinct("code").alias("codes"))
    return p.groupBy("py").agg(F.count_distinct("obj_id").alias("objects"), F.array_join(F.array_sort(F.collect_set(F.col("obj_id").cast("string"))), ",").alias("ids")).join(codes, "py")


def _laid(s, d):
    """Masks blended on a grey image one after the other, each cut to whole channel values."""
    return M.visualise(A.presence(s, d), PX)


def _outlines(s, d):
    """Outlines of 32 x 32 enlargements, cut where a value is over the middle."""
    big = R.resize_nearest(R.min_max(spread(A.rasters(s, d))), 32, 32)
    return O.properties(O.PipelineBuilder().with_threshold(128).with_simplification(0.5).with_minimum_area(4).with_validation().build().run(big)).select("image_id", "shape_id", F.round("area", 4).alias("area"), "has_holes", "hole_count", F.round("perimeter", 4).alias("perimeter"))


def _totals(s, d):
    big = R.resize_nearest(R.min_max(spread(A.rasters(s, d))), 32, 32)
    return O.totals(O.PipelineBuilder.comprehensive().run(big)).select("image_id", "shapes", F.round("area", 3).alias("area"), F.round("mean_perimeter", 3).alias("mean_perimeter"), "points")


def _map(s, d):
    """Closed rings as map features, named by label; the include table names those whose label is the key of a nation."""
    r = A.rings(s, d).select(F.concat(F.lit("land "), F.col("label").cast("string")).alias("name"), F.array(F.concat(F.col("ring"), F.slice("ring", 1, 1))).alias("rings"), "shape_id", "label")
    named = r.withColumn("name", F.concat("name", F.lit(" "), F.col("shape_id").cast("string")))
    included = named.join(A.read(s, d, "nation"), F.col("label") == F.col("n_nationkey"), "left_semi").select("name")
    return O.generalise(named.select("name", "rings"), included).select("name", F.round("area", 5).alias("area"), F.size(F.get("rings", F.lit(0))).alias("points"), F.round("mid.x", 5).alias("x"), F.round("mid.y", 5).alias("y"))


def _cue_json(s, d):
    """The JSON of each conversation read again."""
    kind = "array<struct<start_ms:bigint,end_ms:bigint,text:string,speaker:string>>"
    doc = F.from_json("content", kind)
    return S.subtitles_json(A.cues(s, d)).select("conv_id", F.posexplode(doc).alias("nth", "c")).select("conv_id", "nth", "c.start_ms", "c.end_ms", "c.text", "c.speaker")


def _parameter():
    """A parameter's name for each part: of six layers, with one of three endings."""
    k, pick = F.col("p_partkey"), (lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int")))
    layer = pick([".norm1", ".attn.qkv", ".attn.proj", ".mlp.fc1", ".layer_norm.gamma", ".norm"], k % 6)
    return F.concat(F.lit("encoder.blocks."), k.cast("string"), layer, pick([".weight", ".bias", ".scale"], F.floor(k / 6) % 3))


QUERIES = {
    "cues_json": _cue_json,
    "subtitle_rows": lambda s, d: S.subtitles(A.utterances(s, d), "en"),
    "mask_merge_prompts": _merged,
    "frame_picks": _picks,
    "prompt_frames": lambda s, d: A.read(s, d, "part").select("p_partkey", M.prompt_frame(F.col("p_partkey") % 60 - 5, F.col("p_size")).cast("long").alias("frame")),
    "mask_object_sets": _objects,
    "mask_visualise": _laid,
    "mask_red_overlay": lambda s, d: M.red_overlay(A.presence(s, d), PX, [1, 2, 3, 4, 5]),
    "image_outlines": _outlines,
    "image_outline_totals": _totals,
    "map_generalise": _map,
    "letterbox_normalise": lambda s, d: R.pixels_of(R.letterbox(A.rasters(s, d).withColumns({"width": F.lit(16), "height": F.lit(4)}), 24), 6),
    "parameter_names": lambda s, d: A.read(s, d, "part").select("p_partkey", M.renamed_parameter(_parameter()).alias("name")),
    "command_registry": lambda s, d: O.command_table(s).fillna("", ["parameter", "parameter_description"]),
}

_SHOW = "[" + ", ".join(f"greatest(0, prompt - {k})" for k in (50, 40, 30, 20, 10)) + ", prompt, " + ", ".join(f"least(n - 1, prompt + {k})" for k in (10, 20, 30, 40, 50)) + "]"


def _blend_sql(channel: int) -> str:
    """The fold written out for five objects: each present one cuts base * 0.4 + colour * 0.6."""
    value = "100.0::DOUBLE"
    for k, colour in enumerate(M.MASK_COLOURS[:5]):
        value = f"CASE WHEN o{k + 1} THEN floor({value} * 0.4::DOUBLE + {float(colour[channel])}::DOUBLE * 0.6::DOUBLE) ELSE {value} END"
    return f"CAST({value} AS BIGINT)"


def _text(text: str | None) -> str:
    return "'" + (text or "").replace("'", "''") + "'"


def _red_sql(colour: int) -> str:
    value = "100.0::DOUBLE"
    for k in range(1, 6):
        value = f"round_even({value} * 0.7::DOUBLE + CASE WHEN o{k} THEN {colour}.0::DOUBLE * 0.3::DOUBLE ELSE 0.0::DOUBLE END, 0)"
    return f"CAST({value} AS BIGINT)"


ORACLE = {
    "cues_json": f"WITH {A.CUES} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS nth, start_ms, end_ms, text, speaker FROM cues",
    "subtitle_rows": f"WITH {A.UTTERANCES} SELECT media_id, utt_id, s_us AS start_us, e_us AS end_us, transcript AS text, 'Speaker ' || CAST(speaker AS VARCHAR) AS speaker, 'en' AS language FROM utterances",
    "mask_merge_prompts": "SELECT user_id AS px, event_id % 7 AS py, event_type AS obj, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 7, event_type ORDER BY event_id % 3 DESC, event_id DESC) = 1",
    "frame_picks": f"""WITH p AS (SELECT p_partkey, p_partkey % 200 AS prompt, 60 + p_size AS n FROM part), e AS (SELECT p_partkey, unnest({_SHOW}) AS frame, unnest(range(11)) AS k FROM p),
f AS (SELECT p_partkey, frame, min(k) AS k FROM e GROUP BY ALL) SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1 AS INTEGER) AS k, frame FROM f""",
    "prompt_frames": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 60 - 5 BETWEEN 0 AND p_size - 1 THEN p_partkey % 60 - 5 ELSE p_size // 2 END AS BIGINT) AS frame FROM part",
    "mask_object_sets": f"""WITH {A.PRESENCE}, sets AS (SELECT px, py, string_agg(CAST(obj_id AS VARCHAR), ',' ORDER BY obj_id) FILTER (v > 0.5) AS s FROM presence GROUP BY ALL),
c AS (SELECT py, count(DISTINCT coalesce(s, '')) AS codes FROM sets GROUP BY py)
SELECT p.py, count(DISTINCT obj_id) AS objects, string_agg(DISTINCT CAST(obj_id AS VARCHAR), ',' ORDER BY CAST(obj_id AS VARCHAR)) AS ids, any_value(codes) AS codes FROM presence p JOIN c ON p.py = c.py WHERE v > 0.5 GROUP BY p.py""",
    "mask_visualise": f"""WITH {A.PRESENCE}, o AS (SELECT px, py, {', '.join(f'bool_or(obj_id = {k} AND v > 0.5) AS o{k}' for k in range(1, 6))} FROM presence GROUP BY ALL)
SELECT px, py, {', '.join(f'{_blend_sql(k)} AS {c}' for k, c in enumerate('rgb'))} FROM o""",
    "letterbox_normalise": f"""WITH {A.RASTERS}, g AS (SELECT image_id, i % 24 AS x, i // 24 AS y FROM (SELECT DISTINCT image_id FROM px), range(576) r(i))
SELECT g.image_id, CAST(g.x AS INTEGER) AS x, CAST(g.y AS INTEGER) AS y, round(coalesce(p.v, 0.0), 6) + 0.0 AS v FROM g LEFT JOIN px p ON p.image_id = g.image_id AND g.y BETWEEN 9 AND 14 AND p.y * 8 + p.x = (g.y - 9) * 4 // 6 * 16 + g.x * 16 // 24""",
    "command_registry": "SELECT * FROM (VALUES " + ", ".join(f"({_text(name)}, {_text(text)}, {_text(p)}, {_text(about)}, {str(p is not None).lower()})" for name, (text, parameters) in O.COMMANDS.items() for p, about in parameters or ((None, None),)) + ") v(command, description, parameter, parameter_description, required)",
    "mask_red_overlay": f"""WITH {A.PRESENCE}, o AS (SELECT px, py, {', '.join(f'bool_or(obj_id = {k} AND v > 0.5) AS o{k}' for k in range(1, 6))} FROM presence GROUP BY ALL)
SELECT px, py, {_red_sql(255)} AS r, {_red_sql(0)} AS g, {_red_sql(0)} AS b FROM o""",
    "map_generalise": f"""WITH RECURSIVE {LISTS}, closed AS (SELECT shape_id, label, list_concat(xs, xs[:1]) AS xs, list_concat(ys, ys[:1]) AS ys, (list_max(xs) - list_min(xs)) * (list_max(ys) - list_min(ys)) AS area, (list_min(xs) + list_max(xs)) / 2 AS mx, (list_min(ys) + list_max(ys)) / 2 AS my FROM rl
  WHERE label IN (SELECT n_nationkey FROM nation)), big AS (SELECT * FROM closed WHERE area >= 0.1), {visvalingam_sql(0.01, 'big')}
SELECT 'land ' || CAST(label AS VARCHAR) || ' ' || CAST(shape_id AS VARCHAR) AS name, round(area, 5) AS area, CAST(len(vw.xs) AS INTEGER) AS points, round(mx, 5) AS x, round(my, 5) AS y FROM vw JOIN big USING (shape_id) WHERE len(vw.xs) >= 4""",
    "parameter_names": """WITH named AS (SELECT p_partkey, 'encoder.blocks.' || CAST(p_partkey AS VARCHAR) || ['.norm1', '.attn.qkv', '.attn.proj', '.mlp.fc1', '.layer_norm.gamma', '.norm'][p_partkey % 6 + 1] || ['.weight', '.bias', '.scale'][p_partkey // 6 % 3 + 1] AS name FROM part),
bare AS (SELECT *, replace(replace(name, '.weight', ''), '.bias', '') AS b FROM named)
SELECT p_partkey, replace(replace(CASE WHEN NOT contains(b, 'norm') OR contains(b, 'gamma') OR contains(b, 'beta') THEN b WHEN name LIKE '%.weight' THEN replace(b, 'norm', 'norm.gamma') WHEN name LIKE '%.bias' THEN replace(b, 'norm', 'norm.beta') ELSE b END,
  'attn.qkv', 'attn.query'), 'attn.proj', 'attn.output') AS name FROM bare""",
}
