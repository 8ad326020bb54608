"""Secret scans: patterns, and Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import sample_by_id

# The patterns and least lengths of the base kinds, and the order of kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20+ characters: a match runs to the end of its run, so failing ones hide nothing
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24+ characters, likewise
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

#: Matches that are added up one by one.
BLOCK = 256

#: Runs of these characters are what the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def spans(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    """array<struct<start, kind, end, word>> of leftmost non-overlapping matches, in code points.

    What split leaves between the matches gives their places.  With group,
    matches whose group has fewer than least characters are dropped afterwards.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int,word:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.transform(
        F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"), parts.alias("p")),
        lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), x["p"].alias("word")),
    )

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["len"]).alias("end"), x["word"].alias("word"))
        return F.struct((start + x["len"]).alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def shifted(a: Column, x: Column) -> Column:
        moved = F.transform(x["out"], lambda m: F.struct((m["start"] + a["at"]).alias("start"), m["kind"].alias("kind"), (m["end"] + a["at"]).alias("end"), m["word"].alias("word")))
        return F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], moved).alias("out"))

    # Matches are added up in blocks and blocks then joined, so that many of them cost little more than their number;
    # the array of one element makes a variable of the steps, which are not computed again for each block.
    def blocks(all_steps: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda i: F.aggregate(F.slice(all_steps, i * BLOCK + 1, F.lit(BLOCK)), begin, step))

    folded = F.aggregate(F.element_at(F.transform(F.array(steps), blocks), 1), begin, shifted, lambda a: a["out"])
    folded = F.filter(folded, lambda x: F.length(x["word"]) >= least) if least else folded
    return F.when(text.rlike(pattern), folded).otherwise(none)


def codes(word: Column) -> Column:
    """Code of each character of an ASCII word, in one pass."""
    return F.transform(F.split(word, ""), lambda c: F.ascii(c))


def labelled_samples(docs: DataFrame, sample_rows: int = 4000, generated: int = 3000, seed: int = 11) -> DataFrame:
    """Labelled strings (word, is_random) to train on.

    Ordinary identifiers: the runs of four and more characters outside base
    matches in the sample_rows documents of smallest id hash, the documented
    bound of the sample.  Random: the values of base matches there, and
    generated strings over the Base64, hexadecimal and capital alphabets.
    """
    spark = docs.sparkSession
    rows = sample_by_id(docs.select("doc_id", "text"), sample_rows, seed)
    text = F.col("text")
    values = F.concat(F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))
    rest = text
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = F.regexp_extract_all(rest, F.lit(TOKEN + "{4,}"), F.lit(0))
    both = F.concat(F.transform(ordinary, lambda w: F.struct(w.alias("word"), F.lit(False).alias("is_random"))), F.transform(values, lambda w: F.struct(w.alias("word"), F.lit(True).alias("is_random"))))
    read = rows.select(F.explode(both).alias("x")).select("x.word", "x.is_random")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    alphabets = F.array(F.translate(F.base64(F.unhex(digest)), "=", ""), F.substring(digest, 1, 40), F.substring(F.upper(F.translate(F.base64(F.unhex(digest)), "+/=", "")), 1, 24))
    made = spark.range(generated).select(F.explode(alphabets).alias("word"), F.lit(True).alias("is_random"))
    return read.unionByName(made)


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of character pairs, random over ordinary, at 128 * code + next code.

    Each model's chance of a character after another is smoothed towards the
    uniform one, so without samples every ratio is 0.  At most 2 * 67^2 counts
    come to the driver.
    """
    c = F.col("codes")
    pairs = F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.element_at(c, i) * 128 + F.element_at(c, i + 1))
    counted = samples.where(F.length("word") > 1).select("is_random", codes(F.col("word")).alias("codes")).select("is_random", F.explode(pairs).alias("pair"))
    counts = {(r, p): n for r, p, n in counted.groupBy("is_random", "pair").count().collect()}
    letters = [ord(x) for x in ALPHABET]
    table = [0.0] * (128 * 128)
    for a in letters:
        logs = []
        for random in (True, False):
            row = [counts.get((random, 128 * a + b), 0) + smoothing for b in letters]
            logs.append([math.log(x / sum(row)) for x in row])
        for b, yes, no in zip(letters, *logs, strict=True):
            table[128 * a + b] = round(yes - no, 4)
    return table


def ratio(word: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a word of ALPHABET."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded into one constant
    step = lambda a, c: F.struct((a["sum"] + F.coalesce(F.get(table, a["last"] * 128 + c), F.lit(0.0))).alias("sum"), c.alias("last"))
    return F.aggregate(codes(word), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last")), step, lambda a: a["sum"])


def find_secrets(docs: DataFrame, model: list[float], least: int = 16, threshold: float = 12.0, per_character: float = 0.4) -> DataFrame:
    """doc_id, base and random: arrays of struct<start, kind, end, word>, places in code points.

    base holds the matches of the fixed patterns.  random holds the runs of
    least and more token characters that overlap none of them and whose
    log-likelihood ratio reaches threshold, and per_character a character.
    A null text is empty; no other column than doc_id and text plays a part,
    and rows that repeat are reported each.  Native column expressions only:
    nothing is shuffled, and a long text costs its own length.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", spans(F.col("text"), ASSIGN, 0, 2, ASSIGN_LEAST).alias("assign"), spans(F.col("text"), ACCESS, 1).alias("access"), spans(F.col("text"), HEX, 2).alias("hex"), spans(F.col("text"), f"{TOKEN}{{{least},}}", 3).alias("tokens"))
    rows = rows.select("doc_id", F.concat("assign", "access", "hex").alias("base"), "tokens")
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    rows = rows.select("doc_id", "base", free.alias("free"))
    judged = F.transform("free", lambda t: F.struct(t.alias("t"), ratio(t["word"], model).alias("r")))
    random = F.transform(F.filter(judged, lambda x: x["r"] >= F.greatest(F.lit(threshold), per_character * F.length(x["t"]["word"]))), lambda x: x["t"])
    return rows.select("doc_id", "base", random.alias("random"))


def listed(found: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["start"], x["kind"], x["end"]))), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(found: DataFrame) -> DataFrame:
    """Per document: counts of base kinds, a digest of base spans and the list of all spans."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "random")).alias("spans"),
    )
