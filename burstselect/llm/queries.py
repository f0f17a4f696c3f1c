"""One registered query for each operator of this folder, over whole tables, and its SQL where SQL can express it.

The operators have results of their own; the queries derive the columns that are compared from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstselect.llm import ann, bpe, langid, line_dedup, merkle, packing, periodic, pii, suffix_dedup, tokens, toxicity
from burstselect.llm.common import hash_split, text_or_empty
from burstselect.llm.exact_dedup import exact_groups
from burstselect.llm.simhash_dedup import near_groups
from burstselect.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines it has, and which of them go (numbers from 0, comma-joined)."""
    rows = line_dedup.duplicate_lines(table(spark, sf_dir, "documents"))
    return rows.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), carry={"text_sha256": sha256(text_or_empty())})


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = hash_split("doc_id", 4) == 2
    model = langid.sample(docs, "lang", "text", ~held_out)
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest_only=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), 20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = hash_split("doc_id", 5) == 0
    model = toxicity.fit(docs, labels, ~held_out)
    scores = toxicity.scored(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, sha256(listed("base")).alias("base_sha256"), listed("spans").alias("spans"))


def with_loops(docs: DataFrame) -> DataFrame:
    """The documents, where of those whose crc32 of the id divides by ten some words of the text are made to repeat with a period."""
    words = F.filter(F.split(text_or_empty(), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", text_or_empty().alias("text"), h.alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.expr("g % greatest(size(w), 1)")).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    again = F.expr("transform(sequence(0, size(w) - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)])")
    return rows.select("doc_id", F.when(F.size("w") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_loops(table(spark, sf_dir, "documents")))
    best = F.expr("element_at(array_sort(runs, (x, y) -> case when x.length <> y.length then if(x.length > y.length, -1, 1)"
                  " when x.start <> y.start then if(x.start < y.start, -1, 1) else cast(sign(x.period - y.period) as int) end), 1)")  # fmt: skip
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha256(listed).alias("runs_sha256"),
        sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), scratch_path(spark, "tokens")
    tokens.write_tokens(docs, vocabulary("word_bpe_49k.json"), out)
    read = tokens.read_tokens(spark, out, docs.schema["doc_id"].dataType.simpleString())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = [F.col(c).cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in values]
    rows = docs.select(
        "doc_id", "lang", merkle.leaf(*map(F.col, values)).alias("leaf"), F.when(hash_split("doc_id", 7) == 0, merkle.leaf(*tampered)).alias("tampered")
    )
    found = merkle.proofs(merkle.manifest(rows, "lang", ["doc_id"]))
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("siblings")))
    proof = sha256(F.array_join(F.transform("siblings", lambda s: s["digest"]), ""))
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_bpe": op5_bpe,
    "op6_language_id": op6_language_id,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_nearest": op8_nearest,
    "op9_toxicity": op9_toxicity,
    "op10_private": op10_private,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_output": op12_token_output,
    "op13_merkle": op13_merkle,
}

ORACLES = {
    "op3_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
               doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
    "op8_nearest": """
        with v as (
          select vec_id, cast(embedding as double[]) as e from embeddings
          where len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
                and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        pairs as (
          select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e) as score
          from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0)
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
        from pairs qualify rank <= 20""",
    # crc32 bit by bit; then the levels of all trees, one below the other; then each leaf is folded along its siblings.
    "op13_merkle": """
        with recursive crc as (
          select doc_id, cast(doc_id as varchar) as s, 1 as i, cast(4294967295 as bigint) as c from documents
          union all
          select doc_id, s, i + 1, list_reduce(list_prepend(xor(c, cast(ascii(s[i]) as bigint)), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))
          from crc where i <= length(s)),
        hashed as (select doc_id, xor(c, 4294967295) as h from crc where i > length(s)),
        fields as (
          select doc_id, lang, n_chars, list_transform([cast(doc_id as varchar), source, lang], lambda v: coalesce(strlen(v) || ':' || v, '-')) as f,
                 coalesce(strlen(text) || ':' || text, '-') as t, h % 7 = 0 as hit
          from documents join hashed using (doc_id)),
        leaves as (
          select doc_id, lang, sha256(array_to_string(f, '') || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') || t) as leaf,
                 sha256(array_to_string(f, '') || coalesce(strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1), '-') || t) as other, hit,
                 dense_rank() over (order by lang nulls first) - 1 as tree,
                 row_number() over (partition by lang order by doc_id) - 1 as place, count(*) over (partition by lang) as n
          from fields),
        nodes as (
          select tree, place, 0 as level, n, leaf as d from leaves
          union all
          select a.tree, a.place // 2, a.level + 1, (a.n + 1) // 2, sha256(a.d || coalesce(b.d, ''))
          from nodes a left join nodes b on b.tree = a.tree and b.level = a.level and b.place = a.place + 1
          where a.n > 1 and a.place % 2 = 0),
        tops as (select tree as place, d, count(*) over () as n from nodes where n = 1),
        above as (
          select place, 0 as level, n, d from tops
          union all
          select a.place // 2, a.level + 1, (a.n + 1) // 2, sha256(a.d || coalesce(b.d, ''))
          from above a left join above b on b.level = a.level and b.place = a.place + 1
          where a.n > 1 and a.place % 2 = 0),
        inner_steps as (
          select l.doc_id, m.level, l.place >> m.level as spot, s.d
          from leaves l join (select distinct tree, level from nodes where n > 1) m using (tree)
          left join nodes s on s.tree = l.tree and s.level = m.level and s.place = xor(l.place >> m.level, 1)),
        steps as (
          select doc_id, level, spot % 2 = 1 as before, d from inner_steps
          union all
          select l.doc_id, 1000 + m.level, (l.tree >> m.level) % 2 = 1, s.d
          from leaves l cross join (select distinct level from above where n > 1) m
          left join above s on s.level = m.level and s.place = xor(l.tree >> m.level, 1)),
        paths as (
          select doc_id, list({'before': before, 'd': d} order by level) as path from steps group by doc_id),
        folded as (
          select doc_id, case when hit then other else leaf end as d, 1 as i, path from leaves left join paths using (doc_id)
          union all
          select doc_id, case when path[i].before then sha256(path[i].d || d) else sha256(d || coalesce(path[i].d, '')) end, i + 1, path
          from folded where i <= coalesce(len(path), 0))
        select l.doc_id, l.leaf, t.d as subroot, r.d as root,
               sha256(coalesce(array_to_string(list_transform(path, lambda p: coalesce(p.d, '')), ''), '')) as proof_sha256, f.d as folded_root, f.d = r.d as verified
        from leaves l join tops t on t.place = l.tree cross join (select d from above where n = 1) r
        join folded f on f.doc_id = l.doc_id and f.i > coalesce(len(f.path), 0)""",
}
