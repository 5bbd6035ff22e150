"""Prompt construction and batch text generation behind a pluggable generator."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

# Decoding defaults of the reference predictor.
DEFAULT_GENERATION_ARGS = {"temperature": 1.0, "max_length": 4096, "top_p": 0.9, "top_k": 9}

# Our default instructions; pass the text a fine-tuned model was trained with.
DEFAULT_SYSTEM_PROMPT = (
    "You assess whether a compound is likely to be approved as a drug. You receive its computed "
    "properties and the properties of its five most similar approved and five most similar "
    "unapproved reference compounds. Reason step by step, then answer in this format:\n"
    "<think>\n(reasoning)\n</think>\n<label>\n(approved or unapproved)\n</label>\n"
    "<score>\n(confidence between 0 and 1)\n</score>"
)
DEFAULT_USER_TEMPLATE = (
    "Compound properties: {features}\n\n"
    "Most similar approved compounds: {approved}\n\n"
    "Most similar unapproved compounds: {unapproved}"
)

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def render_template(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` placeholders with columns by concatenation (JVM-side)."""
    parts, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(F.coalesce(fields[m.group(1)].cast("string"), F.lit("")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def build_prompt(df: DataFrame, fields: dict[str, str], system_prompt: str = DEFAULT_SYSTEM_PROMPT,
                 template: str = DEFAULT_USER_TEMPLATE, out: str = "prompt") -> DataFrame:
    """Add ``prompt array<struct<role, content>>``: system message + user message."""
    user = render_template(template, {k: F.col(v) for k, v in fields.items()})
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return df.withColumn(out, F.array(msg("system", F.lit(system_prompt)), msg("user", user)))


def merge_generation_args(**overrides) -> dict:
    """Defaults updated with the given (non-None) settings."""
    args = dict(DEFAULT_GENERATION_ARGS)
    args.update({k: v for k, v in overrides.items() if v is not None})
    return args


def template_generator_factory(options: dict):
    """A deterministic stand-in generator (for tests and dry runs).

    Label from the parity of the user message length, score from its last
    two digits; the answer uses the tagged format.
    """

    def generate(prompts: list) -> list[str]:
        out = []
        for prompt in prompts:
            n = len(prompt[-1]["content"])
            label = "approved" if n % 2 == 0 else "unapproved"
            out.append(f"<think>\nuser message of {n} characters\n</think>\n<label>\n{label}\n</label>\n"
                       f"<score>\n{(n % 100) / 100:.2f}\n</score>")
        return out

    return generate


def batch_generate(df: DataFrame, generator_factory=template_generator_factory, prompt: str = "prompt",
                   key: str = "id", out: str = "generated", options: dict | None = None,
                   batch_size: int = 8, keep: list[str] | tuple = (), partitions: int | None = None,
                   store: str | None = None, chunks: int = 16) -> DataFrame:
    """Run a generator over prompts, partition-parallel, via ``mapInArrow``.

    ``generator_factory(options)`` is called once per task (load a model
    there); the returned callable maps a list of prompts to a list of texts
    and is fed ``batch_size`` prompts at a time.  ``keep`` columns are
    passed through unchanged (so callers need not join the input back).
    The prompts are dealt to ``partitions`` tasks (default: the cluster's
    task slots) first: a generator's cost per row dwarfs the shuffle, and the
    plan before it may have left all rows in one task.

    With ``store`` the job can be resumed: answers are kept in that folder by
    a digest of prompt and options, each distinct prompt is answered once,
    and the work is committed in ``chunks`` parts.  A job that is started
    again with the same folder generates only what is missing there.  A NULL
    prompt is answered as an empty one.
    """
    opts = merge_generation_args(**(options or {}))
    keep = [c for c in keep if c not in (key, prompt)]
    tasks = partitions or df.sparkSession.sparkContext.defaultParallelism
    if store is None:
        src = df.select(key, *keep, prompt).repartition(tasks)
        return _generated(src, generator_factory, opts, prompt, out, batch_size).drop(prompt)
    _fill_store(df, generator_factory, opts, prompt, out, batch_size, tasks, store, chunks)
    from leafwise.operators.scan import attach
    from leafwise.session import scratch_dir

    spark = df.sparkSession
    keyed = df.select(key, *keep, _prompt_digest(prompt, opts).alias("__digest"))
    counted = scratch_dir(spark, "prompt_rows")
    keyed.groupBy("__digest").agg(F.count(F.lit(1)).alias("__rows")).write.parquet(counted)
    answers = spark.read.parquet(store).select("__digest", F.col("answer").alias(out)).dropDuplicates(["__digest"])
    return attach(keyed, answers.join(spark.read.parquet(counted), "__digest"), "__digest", "__rows").select(key, *keep, out)


def _prompt_digest(prompt: str, opts: dict) -> Column:
    """Names an answer: the prompt and the settings it is generated with."""
    settings = json.dumps(opts, sort_keys=True, default=str)
    return F.sha2(F.concat(F.lit(settings), F.lit("\n"), F.coalesce(F.to_json(prompt), F.lit(""))), 256)


def _generated(src: DataFrame, generator_factory, opts: dict, prompt: str, out: str, batch_size: int) -> DataFrame:
    """``src`` plus the generator's answer to each prompt; other columns pass as they are, NULL and large ids included."""
    schema = StructType([*src.schema.fields, StructField(out, StringType())])

    def run(batches):
        import pyarrow as pa

        generate = generator_factory(opts)
        for batch in batches:
            prompts = [p if p is not None else [{"role": "user", "content": ""}] for p in batch.column(prompt).to_pylist()]
            texts = []
            for i in range(0, len(prompts), batch_size):
                texts.extend(generate(prompts[i:i + batch_size]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return src.mapInArrow(run, schema)


def _fill_store(df: DataFrame, generator_factory, opts: dict, prompt: str, out: str, batch_size: int, tasks: int,
                store: str, chunks: int) -> None:
    """Answer the distinct prompts that ``store`` lacks, one committed chunk after the other."""
    from leafwise.session import scratch_dir

    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    wanted = df.groupBy(_prompt_digest(prompt, opts).alias("__digest")).agg(F.first(prompt).alias(prompt))
    if there:
        done = spark.read.schema("__digest string, answer string").parquet(store)
        wanted = wanted.join(done.select("__digest"), "__digest", "left_anti")
    todo = scratch_dir(spark, "prompts")
    chunk = F.pmod(F.xxhash64("__digest"), F.lit(chunks)).cast("int")
    wanted.withColumn("__chunk", chunk).repartition("__chunk").write.partitionBy("__chunk").parquet(todo)
    schema = StructType([StructField("__digest", StringType()), StructField(prompt, df.schema[prompt].dataType), StructField("__chunk", IntegerType())])
    missing = spark.read.schema(schema).parquet(todo)
    for i in range(chunks):
        some = missing.where(F.col("__chunk") == i).select("__digest", prompt)
        if not some.isEmpty():
            answers = _generated(some.repartition(tasks), generator_factory, opts, prompt, "answer", batch_size)
            answers.select("__digest", "answer").write.mode("append").parquet(store)
    if not there and missing.isEmpty():       # no prompts at all: an empty store
        spark.createDataFrame([], "__digest string, answer string").write.mode("append").parquet(store)
