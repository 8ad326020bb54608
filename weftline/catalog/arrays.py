"""Array operators on embeddings: each vector of 64 is an array of 4 steps, 4 frequencies and 4 channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import axis
from weftline.operators import arrays as a
from weftline.operators.labelled import Coordinates, Labelled, Linear, concatenate
from weftline.session import table

SHAPE, DIMS = (4, 4, 4), ("step", "freq", "ch")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("data"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    return a.to_long(_packed(spark, d), ["vec_id"], "data", SHAPE, DIMS)


def array_long(spark, d):
    return _long(spark, d)


def array_round_trip(spark, d):
    x = a.to_packed(_long(spark, d), ["vec_id"], DIMS)
    return x.select("vec_id", F.size("data").alias("n"), F.round(F.aggregate(F.transform("data", lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v), 6).alias("weighted"))


def isel(spark, d):
    return a.isel(_long(spark, d), "freq", slice(1, 4, 2), 4)


def isel_last(spark, d):
    return a.isel(_long(spark, d), "ch", -1, 4)


def isel_list(spark, d):
    return a.isel(_long(spark, d), "freq", [3, 0, 3], 4)


def sel(spark, d):
    """Frequencies at 10, 12.5, 15, 17.5: from 11.25 (to even: place 0) to 16 (place 2, left out)."""
    return a.sel(_long(spark, d), "freq", 11.25, 16.0, 4, gain=2.5, offset=10.0)


def slice_axis(spark, d):
    return a.slice_along(_long(spark, d), "step", 2, 4)


def transpose(spark, d):
    x = _packed(spark, d).select("vec_id", a.transpose_packed(F.col("data"), SHAPE, (2, 1, 0)).alias("data"))
    return x.select("vec_id", F.posexplode("data").alias("i", "value"))


def transpose_long(spark, d):
    """Each element's place in row-major order of the reversed dimensions."""
    x = a.transpose(_long(spark, d), DIMS)
    return a.to_packed(x, ["vec_id"], [c for c in x.columns if c in DIMS]).select("vec_id", F.posexplode("data").alias("i", "value"))


def as2d(spark, d):
    return a.as_2d(_long(spark, d), DIMS, SHAPE, "freq")


def shape2d(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", a.shape_2d(F.array(F.lit(4), F.lit(4), F.size("embedding")), 2).alias("s"))
    return x.select("vec_id", "s.rows", "s.cols")


def iter_axis(spark, d):
    return a.iter_over(_long(spark, d), "step").groupBy("vec_id", "step_index").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def concat_axis(spark, d):
    x = _long(spark, d).withColumn("key", F.lit("a"))
    return a.concatenate([x, x.withColumn("key", F.lit("b"))], "step", [4, 4])


def stack_axis(spark, d):
    x = _long(spark, d).withColumn("key", F.lit("a"))
    return a.concatenate([x, x], "batch", [1, 1], new=True)


def _labelled(spark, d, key: str, *names: str) -> Labelled:
    """Frequencies at 10, 12.5, 15, 17.5, and channels with names."""
    axes = {"freq": Linear(2.5, 10.0, "Hz"), "ch": Coordinates(names)}
    return Labelled(_long(spark, d), DIMS, SHAPE, axes, key)


def labelled_concat(spark, d):
    """Named channels end to end, of the arrays of one key."""
    x, y = _labelled(spark, d, "eeg", "c0", "c1", "c2", "c3"), _labelled(spark, d, "eeg", "x0", "x1", "x2", "x3")
    z = concatenate(x, _labelled(spark, d, "other", "o0", "o1", "o2", "o3"), y, dim="ch", filter_key="eeg")
    return z.with_labels().withColumn("key", F.lit(z.key))


def labelled_stack(spark, d):
    """Arrays of two keys along a new dimension with an axis of its own."""
    z = concatenate(_labelled(spark, d, "a", "c0", "c1", "c2", "c3").isel(ch=[3, 0]), _labelled(spark, d, "b", "c0", "c1", "c2", "c3").isel(ch=[3, 0]), dim="run", axis=Linear(60.0, 5.0, "s"))
    return z.with_labels().withColumn("key", F.lit(z.key))


def labelled_sel(spark, d):
    """By labels, then transposed; axes follow."""
    z = _labelled(spark, d, "a", "c0", "c1", "c2", "c3").sel(freq=slice(12.5, 17.5)).isel(ch=slice(1, 4, 2)).transpose()
    return z.with_labels()


def sliding_window(spark, d):
    x = _packed(spark, d).select("vec_id", F.posexplode(a.sliding_windows("data", 50, 7)).alias("win", "w"))
    return x.select("vec_id", "win", F.size("w").alias("n"), F.round(F.aggregate("w", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def sliding_window_long(spark, d):
    x = _packed(spark, d).select("vec_id", F.posexplode("data").alias("at", "value"))
    return a.sliding_windows_long(x, ["vec_id"], "at", 8, 4, 64).groupBy("vec_id", "win").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def chunk_array(spark, d):
    x = _packed(spark, d).select("vec_id", F.explode(a.chunks("data", 19, 1000.0)).alias("c"))
    return x.select("vec_id", "c.chunk", F.round("c.offset", 9).alias("offset"), F.size("c.data").alias("n"))


def rename_axis(spark, d):
    x = a.isel(_long(spark, d), "step", 1, 4)
    return a.rename_dims(x, {"step": None, "freq": "time"})


def elementwise(spark, d):
    x = _packed(spark, d).select("vec_id", a.elementwise("data", lambda v: v + 1, lambda v: F.pow(v, F.lit(2.0))).alias("y"))
    return x.select("vec_id", F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def axis_value(spark, d):
    return table(spark, d, "events").select("event_id", F.round(axis.axis_value("event_id", 0.25, -50.0), 6).alias("v"))


def axis_index(spark, d):
    return table(spark, d, "events").select("event_id", axis.axis_index("value", 0.25, -50.0).alias("nearest"), axis.axis_index("value", 0.25, -50.0, "floor").alias("below"), axis.axis_index("value", 0.25, -50.0, "ceil").alias("above"))


def axis_values(spark, d):
    x = table(spark, d, "nation").select("n_nationkey", F.posexplode(axis.axis_values(F.col("n_nationkey"), 0.5, 1.0)).alias("i", "v"))
    return x


def coordinate_axis(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", axis.coordinate(F.array(*[F.lit(f"ch{i}") for i in range(8)]), F.col("label")).alias("name"))


def time_axis(spark, d):
    x = table(spark, d, "nation").select("n_nationkey", axis.time_axis((F.col("n_nationkey") + 1).cast("double"), 0.5).alias("t"))
    return x.select("n_nationkey", "t.kind", "t.unit", F.round("t.gain", 9).alias("gain"), "t.offset")


_FNS = (array_long, array_round_trip, isel, isel_last, isel_list, sel, slice_axis, transpose, transpose_long, as2d, shape2d, iter_axis, concat_axis, stack_axis, labelled_concat, labelled_stack, labelled_sel, sliding_window, sliding_window_long, chunk_array, rename_axis, elementwise, axis_value, axis_index, axis_values, coordinate_axis, time_axis)
QUERIES = {f.__name__: f for f in _FNS}
L_ = """l as (select vec_id, (i // 16)::integer as step, (i // 4 % 4)::integer as freq, (i % 4)::integer as ch, embedding[i + 1]::double as value from embeddings, (select unnest(range(64)) as i))"""
SQL = {
    "array_long": f"with {L_} select * from l",
    "array_round_trip": f"with {L_} select vec_id, count(*)::integer as n, round(sum(value * (16 * step + 4 * freq + ch)), 6) as weighted from l group by vec_id",
    "isel": f"with {L_} select vec_id, step, (freq // 2)::integer as freq, ch, value from l where freq in (1, 3)",
    "isel_last": f"with {L_} select vec_id, step, freq, 0::integer as ch, value from l where ch = 3",
    "isel_list": f"with {L_} select vec_id, step, x.i::integer as freq, ch, value from l join (values (0, 3), (1, 0), (2, 3)) x(i, p) on l.freq = x.p",
    "sel": f"with {L_} select * from l where freq < 2",
    "slice_axis": f"with {L_} select vec_id, freq, ch, value from l where step = 2",
    "transpose": f"with {L_} select vec_id, (16 * ch + 4 * freq + step)::integer as i, value from l",
    "transpose_long": f"with {L_} select vec_id, (16 * ch + 4 * freq + step)::integer as i, value from l",
    "as2d": f"with {L_} select vec_id, freq as row, (4 * step + ch)::integer as col, value from l",
    "shape2d": "select vec_id, len(embedding)::bigint as rows, 16::bigint as cols from embeddings",
    "iter_axis": f"with {L_} select vec_id, step as step_index, count(*) as n, round(sum(value), 6) as total from l group by all",
    "concat_axis": f"with {L_} select vec_id, step, freq, ch, value, '' as key from l union all select vec_id, step + 4, freq, ch, value, '' from l",
    "stack_axis": f"with {L_} select l.*, b.i::integer as batch, 'a' as key from l, (values (0), (1)) b(i)",
    "labelled_concat": f"""with {L_} select vec_id, step, freq, (ch + 4 * p)::integer as ch, value, step::double as step_label, freq * 2.5::double + 10 as freq_label,
        case p when 0 then 'c' else 'x' end || ch as ch_label, 'eeg' as key from l, (values (0), (1)) b(p)""",
    "labelled_stack": f"""with {L_} select run::integer as run, vec_id, step, freq, case ch when 3 then 0 else 1 end::integer as ch, value, run * 60.0::double + 5 as run_label, step::double as step_label,
        freq * 2.5::double + 10 as freq_label, 'c' || ch as ch_label, '' as key from l, (values (0), (1)) b(run) where ch in (0, 3)""",
    "labelled_sel": f"""with {L_} select vec_id, step, (freq - 1)::integer as freq, (ch // 2)::integer as ch, value, step::double as step_label, freq * 2.5::double + 10 as freq_label, 'c' || ch as ch_label
        from l where freq in (1, 2) and ch in (1, 3)""",
    "sliding_window": "with w as (select vec_id, unnest(range(3))::integer as win, embedding from embeddings) select vec_id, win, 50::integer as n, round(list_sum(list_transform(embedding[win * 7 + 1:win * 7 + 50], lambda x: x::double)), 6) as total from w",
    "sliding_window_long": "with w as (select vec_id, unnest(range(15))::integer as win, embedding from embeddings) select vec_id, win, 8::bigint as n, round(list_sum(list_transform(embedding[win * 4 + 1:win * 4 + 8], lambda x: x::double)), 6) as total from w",
    "chunk_array": "select vec_id, c::integer as chunk, round(c * 19 / 1000.0::double, 9) as \"offset\", least(19, 64 - 19 * c)::integer as n from embeddings, (select unnest(range(4)) as c)",
    "rename_axis": f"with {L_} select vec_id, freq as time, ch, value from l where step = 1",
    "elementwise": f"with {L_} select vec_id, round(sum((value + 1) ** 2), 6) as total from l group by vec_id",
    "axis_value": "select event_id, round(event_id * 0.25::double - 50, 6) as v from events",
    "axis_index": "select event_id, round_even((value + 50) / 0.25::double, 0)::bigint as nearest, floor((value + 50) / 0.25::double)::bigint as below, ceil((value + 50) / 0.25::double)::bigint as above from events",
    "axis_values": "select n_nationkey, i::integer as i, i * 0.5::double + 1.0 as v from nation, lateral (select unnest(range(n_nationkey)) as i)",
    "coordinate_axis": "select vec_id, case when label between 0 and 7 then 'ch' || label end as name from embeddings",
    "time_axis": "select n_nationkey, 'linear' as kind, 's' as unit, round(1.0::double / (n_nationkey + 1), 9) as gain, 0.5::double as \"offset\" from nation",
}
