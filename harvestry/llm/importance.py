"""Target-distribution importance resampling: hashed n-gram features counted by DuckDB within tasks, merged and scored by Spark.

Each task gives its texts, in parts of bounded size, to a DuckDB connection of its own: SQL splits them
into words, unnests them, makes n-grams by window functions and hashes each different n-gram with zlib's
CRC-32, a registered function. Bucket counts of each document, and of all that a task has read,
go to Parquet in the shared folder. Spark adds up the task sums into the two distributions (10,000
numbers each), turns them into gains, and reads the documents' counts again to weigh them. The
largest scores are found from counts of score ranges and scores, so that no task ranks all documents.
"""

from __future__ import annotations

import re
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices, texts, values
from .common import documents, join_small, staged

#: Letters, digits and all from U+0080 on, after A-Z are lower-cased.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BUCKETS, MAX_N = 10_000, 1
#: Words that a document must have to be drawn, and the percentage that is drawn.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes of text that one statement works on; a longer text is cut between words.
PART = 2 << 20
#: DuckDB's memory in a task; beyond it, it spills to the task's own folder, which goes with the connection.
MEMORY = "400MB"
#: Scores of one range are ranked together.
RANGE = 64


def crc(column):
    """zlib.crc32 of each text's bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.array([zlib.crc32(x) for x in column.cast(pa.binary()).to_pylist()], pa.uint32())


def gram_sql(max_n: int) -> str:
    """All n-grams of the table `words` (doc, part, skip, pos, word): those whose last word is one of the `skip` first were counted with the part before."""
    each = []
    for n in range(1, max_n + 1):
        before = [f"lag(word, {k}) over w" for k in range(n - 1, 0, -1)]
        gram = "concat_ws(' ', " + ", ".join([*before, "word"]) + ")" if n > 1 else "word"
        each.append(f"select doc, {gram} as gram, pos > skip as own, pos >= {n} as whole from words" + (" window w as (partition by doc, part order by pos)" if n > 1 else ""))
    return "select doc, gram from (" + " union all ".join(each) + ") where own and whole"


def count_sql(max_n: int, buckets: int) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
insert into counts
with lists as (select doc, part, skip, regexp_extract_all({lower}, '{WORDS}') as list from pieces),
words as (select doc, part, skip, generate_subscripts(list, 1) as pos, unnest(list) as word from lists),
grams as materialized (select doc, gram, count(*) as n from ({gram_sql(max_n)}) group by doc, gram),
hashed as materialized (select gram, zlib_crc(gram) % {buckets} as bucket from (select distinct gram from grams))
select doc, bucket, sum(n)::bigint from grams join hashed using (gram) group by doc, bucket"""


def is_word(byte: int) -> bool:
    return byte >= 0x80 or 0x30 <= byte <= 0x39 or 0x41 <= byte <= 0x5A or 0x61 <= byte <= 0x7A


def pieces(rows: pa.RecordBatch, text_col: str, max_n: int, limit: int) -> Iterator[pa.Table]:
    """Tables (doc, part, skip, text) of at most about `limit` bytes. A text cut between words begins with the last max_n - 1 words of the part before, `skip` of them."""
    column = texts(rows, text_col)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    first = 0
    while first < len(column):
        if sizes[first] <= limit:
            last = max(first + 1, first + int(np.searchsorted(np.cumsum(sizes[first:]), limit, "right")))
            n = last - first
            yield pa.table({"doc": pa.array(np.arange(first, last)), "part": pa.array(np.zeros(n, np.int64)), "skip": pa.array(np.zeros(n, np.int64)), "text": column.slice(first, n).cast(pa.large_string())})
            first = last
            continue
        data, at, part, carried = column[first].as_py(), 0, 0, []
        while at < len(data):
            end = min(len(data), at + limit)
            while end < len(data) and is_word(data[end - 1]) and is_word(data[end]):
                end += 1
            chunk = b" ".join([*carried, data[at:end]])
            yield pa.table({"doc": [first], "part": [part], "skip": [len(carried)], "text": pa.array([chunk], pa.large_binary()).cast(pa.large_string())})
            if max_n > 1:
                carried = last_words(chunk, max_n - 1)
            at, part = end, part + 1
        first += 1


def last_words(chunk: bytes, n: int) -> list[bytes]:
    found, end = [], len(chunk)
    while end and len(found) < n:
        while end and not is_word(chunk[end - 1]):
            end -= 1
        start = end
        while start and is_word(chunk[start - 1]):
            start -= 1
        if end > start:
            found.append(chunk[start:end])
        end = start
    return found[::-1]


def bucket_counts(docs: DataFrame, label: str, id_col: str, text_col: str, max_n: int = MAX_N, buckets: int = BUCKETS, part: int = PART) -> DataFrame:
    """Staged: kind 0, a row for each document (id, n_words, buckets, counts); kind 1, the sums of a task (buckets, counts)."""
    names = ["kind", "id", "n_words", "buckets", "counts"]
    kinds = [pa.int8(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches):
        import duckdb

        with tempfile.TemporaryDirectory() as home, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": home, "preserve_insertion_order": False}) as db:
            db.create_function("zlib_crc", crc, ["VARCHAR"], "UINTEGER", type="arrow")
            db.execute("create table counts (doc bigint, bucket integer, n bigint); create table sums (bucket integer, n bigint)")
            count = count_sql(max_n, buckets)
            id_type = None
            for rows, _, _ in slices(batches, text_col, part):
                ids = values(rows, id_col)
                id_type = ids.type
                for piece in pieces(rows, text_col, max_n, part):
                    db.register("pieces", piece)
                    db.execute(count)
                    db.unregister("pieces")
                db.execute("insert into sums select bucket, sum(n) from counts group by bucket")
                got = db.sql("select doc, sum(n)::bigint as n_words, list(bucket order by bucket) as buckets, list(n order by bucket) as counts from (select doc, bucket, sum(n)::bigint as n from counts group by doc, bucket) group by doc order by doc").to_arrow_table().combine_chunks()
                db.execute("truncate counts")
                yield from documents_of(rows, ids, got, names, kinds, text_col, max_n)
            total = db.execute("select list(bucket order by bucket), list(n order by bucket) from (select bucket, sum(n)::bigint as n from sums group by bucket)").fetchone()
            if id_type is not None and total[0]:
                yield pa.RecordBatch.from_arrays([pa.array([1], kinds[0]), pa.nulls(1, id_type), pa.array([0], kinds[1]), pa.array([total[0]], kinds[2]), pa.array([total[1]], kinds[3])], names=names)

    def documents_of(rows, ids, got, names, kinds, text_col, max_n):
        at = np.full(rows.num_rows, -1)
        at[got["doc"].to_numpy()] = np.arange(len(got))
        take = pa.array(np.where(at < 0, 0, at), mask=at < 0)
        if max_n == 1:
            words = pc.fill_null(got["n_words"].combine_chunks().cast(pa.int64()).take(take), 0)
        else:
            words = pa.array([sum(1 for _ in WORD_BYTES.finditer(x)) for x in texts(rows, text_col).to_pylist()], pa.int64())
        lists = [got[c].combine_chunks().cast(kind).take(take) for c, kind in zip(("buckets", "counts"), kinds[2:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows.num_rows), kinds[0]), ids, words, *lists], names=names)

    schema = f"kind tinyint, id {docs.schema[id_col].dataType.simpleString()}, n_words long, buckets array<int>, counts array<long>"
    return staged(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema), label)


def totals(counts: DataFrame) -> DataFrame:
    """bucket, n over all texts, from the sums of the tasks."""
    sums = counts.where("kind = 1").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return sums.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: the array of all buckets' gains."""
    spark = source.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(totals(source).withColumnRenamed("n", "s"), "bucket", "left").join(totals(target).withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    all_s, all_t = F.sum("s").over(Window.partitionBy()), F.sum("t").over(Window.partitionBy())  # `buckets` rows
    d = lambda c: c.cast("double")
    ratio = (d(F.col("t") + 1) * d(all_s + buckets)) / (d(F.col("s") + 1) * d(all_t + buckets))
    both = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))
    return both.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains"))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a u in (0, 1) that the identifier gives."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """rows: id, n_words, score, eligible -> with rank, null unless among floor(percent * N / 100) largest scores of the N eligible rows; ties to the smaller id, null last.

    Counts of score ranges give how many rows lie above a range, counts of scores how many within it lie above
    a score; only rows of equal score are sorted together.
    """
    some = rows.where("eligible")
    by_score = staged(some.groupBy("score").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("score") / RANGE)), "dsir-scores")
    by_range = by_score.groupBy("range").agg(F.sum("n").alias("n"))  # as many rows as the scores' span has ranges
    drawn = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)
    above = by_range.select("range", drawn.alias("drawn"), (F.sum("n").over(Window.orderBy(F.desc("range"))) - F.col("n")).alias("above")).where("above < drawn")
    within = F.sum("n").over(Window.partitionBy("range").orderBy(F.desc("score"))) - F.col("n")
    first = by_score.join(above, "range").select("score", "drawn", (F.col("above") + within).alias("before")).where("before < drawn")
    first = staged(first, "dsir-first")
    won = join_small(some, first, "score")
    order = Window.partitionBy("score").orderBy(F.col("id").isNull(), "id", "row")
    won = won.withColumn("rank", F.col("before") + F.row_number().over(order))
    return won.where(F.col("rank") <= F.col("drawn")).select("row", F.col("rank").cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, part: int = PART) -> DataFrame:
    """One row per document: id_col, n_features, weight, score, rank (null unless drawn).

    Null text has no words: weight 0. A null identifier draws its noise from the text 'null' and is the last of
    its ties; rows that repeat an identifier and a text score alike and are ranked one after the other. Without
    target texts all gains are of the smoothed counts; an empty table gives no rows. Other columns are ignored.
    A long text is counted in parts.
    """
    source = bucket_counts(docs, "dsir-source", id_col, text_col, max_n, buckets, part)
    wanted = bucket_counts(target.select(F.lit(0).alias("item"), F.col(target_col).alias("text")), "dsir-target", "item", "text", max_n, buckets, part)
    gain = staged(gains(source, wanted, buckets), "dsir-gains")  # one row of `buckets` numbers
    n_features = F.coalesce(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    gained = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: F.element_at(F.col("gains"), b + 1) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = source.where("kind = 0").select("id", "n_words", F.monotonically_increasing_id().alias("row"), "buckets", "counts", gain.scalar().alias("gains"))
    rows = rows.select("row", "id", "n_words", n_features.alias("n_features"), gained.alias("gained"))
    weight = F.when(F.col("n_features") > 0, F.expr("(gained - pmod(gained, n_features)) div n_features")).otherwise(0).cast("long")
    rows = rows.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("eligible", F.col("n_words") >= least_words)
    rows = staged(rows.drop("gained"), "dsir-scored")
    rank = staged(ranked(rows, percent), "dsir-ranks")
    return rows.join(rank, "row", "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """All documents, weighed towards the benchmark's texts."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 of four bits at a time, from the polynomial.
def _nibble(i: int) -> int:
    for _ in range(4):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i


ORACLE = f"""
with texts as (
  select 0 as side, doc_id as id, coalesce(text, '') as text from documents
  union all select 1, item_id, coalesce(text, '') from benchmark),
words as (select side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}')) as word from texts),
counted as materialized (select side, id, word, count(*) as n from words group by all),
spelt as (select word, hex(encode(word)) as h, strlen(word) as bytes from (select distinct word from counted)),
nibbles as (select word, list_transform(range(1, 2 * bytes + 1), lambda j: (instr('0123456789ABCDEF', substr(h, case when j % 2 = 1 then j + 1 else j - 1 end, 1)) - 1)::bigint) as list from spelt),
hashed as materialized (select word, xor(list_reduce(list_prepend(4294967295::bigint, list),
    lambda c, b: xor(c >> 4, ({[_nibble(i) for i in range(16)]}::bigint[])[(xor(c, b) & 15) + 1])), 4294967295::bigint) % {BUCKETS} as bucket from nibbles),
sums as (select bucket, sum(n) filter (side = 0) as s, sum(n) filter (side = 1) as t from counted join hashed using (word) group by bucket),
every as (select r.range as bucket, coalesce(s, 0) as s, coalesce(t, 0) as t from range({BUCKETS}) r left join sums on sums.bucket = r.range),
gains as (select bucket, floor(1000 * ln(((t + 1)::double * (sum(s) over () + {BUCKETS})::double) / ((s + 1)::double * (sum(t) over () + {BUCKETS})::double))) as gain from every),
per as (select id, sum(n) as n_features, floor(sum(n * gain) / sum(n)) as weight from counted join hashed using (word) join gains using (bucket) where side = 0 group by id),
scored as (select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296))))::bigint as score
  from documents left join per on id = doc_id),
places as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as many from scored where n_features >= {LEAST_WORDS})
select s.doc_id, n_features, weight, score, case when place <= floor({PERCENT} * many / 100) then place end as rank
from scored s left join places p on p.doc_id = s.doc_id
"""
