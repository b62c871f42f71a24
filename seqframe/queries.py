"""Driver queries of the sequence operators and their oracle SQL.

The tables hold no sequences, so they are derived from the whole texts of `documents`: the view dna keeps A, C, G, T, N of
either case, the view rna is dna transcribed, the view protein the characters of the protein alphabet. Alignment works on
pairs of the whole sequence and its reverse.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import alphabet as A
from .functions import metadata as M
from .functions import packing as P
from .functions import sequence as S
from .operators import align as L
from .operators import parallel as X
from .operators.search import find_all_long
from .plans.pairs import kmer_counts
from .sources import api, fasta, fastq, files


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def _clean(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"[^{chars}]", "")


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "lang", _clean(F.col("text"), A.CHARS[A.DNA]).alias("s"))


def rna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).withColumn("s", A.dna_to_rna("s"))


def protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "lang", _clean(F.col("text"), A.CHARS[A.PROTEIN]).alias("s"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition and motif by language: one scan, one shuffle of a few rows."""
    s = dna(spark, sf_dir).select("lang", S.gc_content("s", A.DNA).alias("gc"), S.count("s", "ata").alias("motif"), F.length("s").alias("n"))
    return s.groupBy("lang").agg(F.count("*").alias("n_seqs"), F.sum("n").alias("n_bases"), F.round(F.avg("gc"), 6).alias("avg_gc"), F.sum("motif").alias("n_motif"))


def _shared(spark: SparkSession) -> str:
    """A new path in the folder that all machines share; a temporary one only where there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="seqframe-")
    return f"{root.rstrip('/')}/seqframe-{uuid.uuid4().hex}"


def _each(value, source=dna, name: str = "result"):
    """A query of doc_id and one value."""
    return lambda spark, sf_dir: source(spark, sf_dir).select("doc_id", value().alias(name))


def _fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared(spark)
    rows = dna(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("lang "), F.col("lang")).alias("description"), F.col("s").alias("seq"))
    api.write_sequences(rows, path, "FASTA")
    return api.read_fasta(spark, path).select(F.col("id").cast("long").alias("doc_id"), "description", "seq", "alphabet")


def _fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared(spark)
    rows = dna(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("description"), F.col("s").alias("seq"), F.repeat(F.lit("I"), F.length("s")).alias("quality"))
    api.write_sequences(rows, path, "FASTQ")
    return api.read_fastq(spark, path).select(F.col("id").cast("long").alias("doc_id"), "description", "seq", "quality")


def _parse_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fasta.to_fasta(F.col("doc_id").cast("string"), F.col("lang"), F.col("s"))
    return dna(spark, sf_dir).select(F.inline(fasta.parse_fasta(text)))


def _parse_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fastq.to_fastq(F.col("doc_id").cast("string"), F.col("lang"), F.col("s"), F.repeat(F.lit("I"), F.length("s")))
    return dna(spark, sf_dir).select(F.inline(fastq.parse_fastq(text)))


def _composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("doc_id", F.explode(S.base_composition("s")).alias("base", "n"))


def _total_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir).select("lang", F.explode(S.base_composition("s")).alias("base", "n"))
    return rows.groupBy("lang", "base").agg(F.sum("n").alias("n"))


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("doc_id", S.count_bases("s").alias("b")).select("doc_id", "b.*")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("doc_id", F.explode(S.find_all("s", "ata")).alias("position"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences and their reverse, dealt out, since a row is far more work to align than to read."""
    s = dna(spark, sf_dir).select("doc_id", F.col("s").alias("a"), F.reverse("s").alias("b"))
    return s.repartition(4 * spark.sparkContext.defaultParallelism)


def _aligned(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = _pairs(spark, sf_dir).filter("a <> ''")
        return pairs.select("doc_id", L.align("a", "b", mode).alias("x")).select("doc_id", "x.*")

    return query


def _score(mode: str):
    return lambda spark, sf_dir: _pairs(spark, sf_dir).filter("a <> ''").select("doc_id", L.align_score("a", "b", mode).alias("score"))


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("s", _clean(F.col("text"), A.CHARS[A.DNA]))
    table = M.sequences(rows, F.col("s"), F.col("doc_id"), F.when(F.col("lang") != "en", F.col("lang")))
    return M.transcribe(M.reverse_complement(M.reverse(table))).select(F.col("id").cast("long").alias("doc_id"), "description", "seq", "alphabet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("doc_id", F.posexplode(X.chunk_slice(F.col("s"), 500)).alias("chunk", "piece"))


def _split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.split_join(dna(spark, sf_dir), "doc_id", X.chunk_slice(F.col("s"), 500), S.complement_dna, lambda parts: F.array_join(parts, ""))


def _map_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.map_items(dna(spark, sf_dir).select("doc_id", "s"), lambda s: s.count("A") + 2 * s.count("t"), "s", "result", "long").select("doc_id", "result")


def _map_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir).select(F.floor(F.col("doc_id") / 100).alias("chunk"), "doc_id", F.length("s").alias("n"))
    return X.map_chunks(rows, lambda values: int(sum((i + 1) * v for i, v in enumerate(values))), "chunk", "n", "doc_id", "long")


def _concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dna(spark, sf_dir).select("doc_id", "s")
    after = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return s.join(after, "doc_id").select("doc_id", S.concatenate("s", "t", A.DNA, A.DNA).alias("result"))


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("s")
    s = dna(spark, sf_dir).filter(n >= 12).select("doc_id", S.view_slide(2, 10, n, 2).alias("slid"), S.view_slide(2, 10, n, -5).alias("back"), S.view_resize(2, n, 4).alias("sized"))
    return s.select("doc_id", F.col("slid.start").alias("slid_start"), F.col("slid.end").alias("slid_end"), F.col("back.start").alias("back_start"), F.col("back.end").alias("back_end"), F.col("sized.end").alias("sized_end"))


def _file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.inline(files.file_chunks(F.col("n_chars").cast("int"), 300)))


def _kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_counts(dna(spark, sf_dir), "s", 3)


def _long_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_all_long(dna(spark, sf_dir), "doc_id", "s", "tnt", piece=200)


def _unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dna(spark, sf_dir).select("doc_id", P.pack_dna("s").alias("p")).select("doc_id", F.hex("p.data").alias("data"), P.unpack_dna("p").alias("result"))


def _unpacked_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protein(spark, sf_dir).select("doc_id", P.pack_protein("s").alias("p")).select("doc_id", P.unpack_protein("p").alias("result"), P.memory_usage("p").alias("n_bytes"))


def _mask_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(F.length("s") - 1, F.lit(0), F.lit(0))
    return dna(spark, sf_dir).select("doc_id", "s", ends.alias("at")).select("doc_id", S.mask("s", "at", "N", "null").alias("result"))


def _constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"dna": A.dna_to_rna(S.as_dna("s", "null")), "rna": S.as_rna(A.dna_to_rna("s"), "null"), "protein": S.as_protein("s", "null"), "any": S.as_sequence("s", "null"), "kind": S.alphabet_or_dna("s")}
    return protein(spark, sf_dir).select("doc_id", *(F.md5(v).alias(k) for k, v in made.items()))


def _rna(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"complement": S.complement("s", A.RNA), "reverse_complement": S.reverse_complement("s", A.RNA), "dna": A.rna_to_dna("s"), "engine": A.complement_sequence("s", A.RNA)}
    return rna(spark, sf_dir).select("doc_id", S.gc_content("s", A.RNA).alias("gc"), A.is_valid("s", A.RNA).alias("valid"), A.detect_alphabet("s").alias("alphabet"), *(v.alias(k) for k, v in made.items()))


def _small_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dna(spark, sf_dir)
    return s.select("doc_id", S.is_empty("s").alias("empty"), F.octet_length(S.to_bytes("s")).alias("n_bytes"), S.equal("s", F.reverse("s")).alias("palindrome"), S.subsequence_clamped("s", 5, 25).alias("clamped"), F.size(S.view_find_all(F.rpad("s", F.greatest(F.length("s"), F.lit(40)), "N"), 4, 40, "a")).alias("in_view"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    tags = api.add_metadata(api.add_metadata(empty, "lang", F.lit("none")), "lang", F.col("lang"))
    made = dna(spark, sf_dir).select("doc_id", api.record(F.col("doc_id").cast("string"), F.col("s"), metadata=tags).alias("r"))
    return made.select("doc_id", F.length("r.seq").alias("n"), api.get_metadata(F.col("r.metadata"), "lang").alias("lang"), api.get_metadata(F.col("r.metadata"), "date").alias("date"))


def _detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("s").alias("seq"), F.repeat(F.lit("I"), F.length("s")).alias("quality"))
    found = []
    for name in api.FORMATS:
        api.create_writer(name)(rows, path := _shared(spark))
        found.append((name, api.detect_format(spark, path), api.read_sequences(spark, path).count()))
    return spark.createDataFrame(found, "written string, detected string, n long")


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dna(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("s").alias("seq"), F.repeat(F.lit("#"), F.length("s")).alias("quality"))
    path = _shared(spark)
    api.write_fastq(rows.filter("length(seq) % 2 = 0"), path)
    api.append_fastq(rows.filter("length(seq) % 2 = 1"), path)
    return api.read_fastq(spark, path).select(F.col("id").cast("long").alias("doc_id"), "seq", "quality")


def _process_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared(spark)
    api.write_fasta(dna(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("s").alias("seq")), path)
    counted = X.process_file(spark, path, lambda chunk: chunk.count(b">"), "long")
    return counted.agg(F.sum("result").alias("n_records"))


QUERIES = {
    "flagship": flagship,
    "detect_alphabet": _each(lambda: A.detect_alphabet("s"), protein),
    "validate": lambda spark, sf_dir: protein(spark, sf_dir).select("doc_id", A.is_valid("s", A.DNA).alias("is_dna"), A.is_valid("s", A.PROTEIN).alias("is_protein")),
    "sanitize": _each(lambda: A.sanitize("s", A.DNA, "N"), protein),
    "length": _each(lambda: S.length("s")),
    "subsequence": lambda spark, sf_dir: dna(spark, sf_dir).select("doc_id", S.subsequence("s", 2, 8, "null").alias("result")),
    "slice_step": _each(lambda: S.seq_slice("s", None, None, 2)),
    "slice_reverse": _each(lambda: S.seq_slice("s", None, None, -1)),
    "char_at": _each(lambda: S.char_at("s", -1, "null")),
    "views": _views,
    "gc_content": _each(lambda: S.gc_content("s", A.DNA)),
    "gc_content_called": _each(lambda: S.gc_content_called("s")),
    "count_bases": _bases,
    "base_composition": _composition,
    "total_composition": _total_composition,
    "find_byte": _each(lambda: F.coalesce(S.find_byte("s", "G"), F.lit(-1))),
    "count_byte": _each(lambda: S.count_byte("s", "a")),
    "reverse": _each(lambda: S.reverse("s")),
    "complement": _each(lambda: S.complement("s", A.DNA)),
    "reverse_complement": _each(lambda: S.reverse_complement("s", A.DNA)),
    "complement_dna": _each(lambda: S.complement_dna("s")),
    "reverse_complement_dna": _each(lambda: S.reverse_complement_dna("s")),
    "transcribe": _each(lambda: S.transcribe("s", A.DNA)),
    "reverse_transcribe": _each(lambda: S.reverse_transcribe(S.transcribe_text("s"))),
    "find_all": _positions,
    "count": _each(lambda: S.count("s", "ata")),
    "kmp_search": _each(lambda: F.array_join(F.transform(S.kmp_search("s", "tion"), lambda x: x.cast("string")), ",")),
    "long_search": _long_search,
    "boyer_moore_search": _each(lambda: F.array_join(F.transform(S.boyer_moore_search("s", "tnta"), lambda x: x.cast("string")), ",")),
    "mask_column": _mask_ends,
    "constructors": _constructors,
    "rna": _rna,
    "small_parts": _small_parts,
    "records": _records,
    "detect_format": _detect_format,
    "append_fastq": _appended,
    "process_file": _process_file,
    "pack_dna_expr": lambda spark, sf_dir: dna(spark, sf_dir).select("doc_id", P.pack_dna_expr("s").alias("p")).select("doc_id", F.hex("p.data").alias("data"), P.unpack_dna("p").alias("result")),
    "identity": _each(lambda: F.round(L.alignment_identity(F.col("s"), F.reverse("s")), 9)),
    "to_fasta_wide": _each(lambda: fasta.to_fasta(F.col("doc_id").cast("string"), None, F.col("s"), 17)),
    "to_fastq": _each(lambda: fastq.to_fastq(F.col("doc_id").cast("string"), F.col("lang"), F.col("s"), F.repeat(F.lit("I"), F.length("s")))),
    "mask": _each(lambda: S.mask("s", [0, 3], "N", "null")),
    "concatenate": _concatenated,
    "molecular_weight": lambda spark, sf_dir: protein(spark, sf_dir).select("doc_id", F.round(S.molecular_weight("s"), 2).alias("result")),
    "random_dna": _each(lambda: S.random_dna(F.length("s"), "doc_id", 7)),
    "pack_dna": _unpacked,
    "pack_protein": _unpacked_protein,
    "metadata": _metadata,
    "fasta_round_trip": _fasta_round_trip,
    "fastq_round_trip": _fastq_round_trip,
    "parse_fasta": _parse_fasta,
    "parse_fastq": _parse_fastq,
    "to_fasta": _each(lambda: fasta.to_fasta(F.col("doc_id").cast("string"), F.col("lang"), F.col("s"))),
    "edit_distance": lambda spark, sf_dir: _pairs(spark, sf_dir).select("doc_id", L.edit_distance("a", "b").alias("result")),
    "align_global": _aligned(L.GLOBAL),
    "align_local": _aligned(L.LOCAL),
    "align_semiglobal": _aligned(L.SEMI_GLOBAL),
    "align_score": _score(L.GLOBAL),
    "chunk_slice": _chunks,
    "split_join": _split_join,
    "map_items": _map_items,
    "map_chunks": _map_chunks,
    "file_chunks": _file_chunks,
    "kmer_counts": _kmers,
}

_DNA = "WITH dna AS (SELECT doc_id, lang, regexp_replace(text, '[^ACGTNacgtn]', '', 'g') AS s FROM documents) "
_PROTEIN = "WITH protein AS (SELECT doc_id, lang, regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYXacdefghiklmnpqrstvwyx*]', '', 'g') AS s FROM documents) "
_n = lambda chars, s="s": f"length(regexp_replace({s}, '[^{chars}]', '', 'g'))"
_find = lambda p: f"list_filter(range(0, greatest(length(s) - {len(p) - 1}, 0)), lambda i: substr(s, CAST(i + 1 AS BIGINT), {len(p)}) = '{p}')"
_pick = lambda value: _DNA + f"SELECT doc_id, {value} AS result FROM dna"
_wrap = "rtrim(regexp_replace(s, '(.{60})', '\\1' || chr(10), 'g'), chr(10))"

ORACLES = {
    "flagship": _DNA + f"SELECT lang, count(*) AS n_seqs, sum(length(s))::BIGINT AS n_bases, round(avg(CASE WHEN s = '' THEN 0.0 ELSE {_n('GCgc')}::DOUBLE / length(s) * 100.0::DOUBLE END), 6) AS avg_gc, sum(len({_find('ata')}))::BIGINT AS n_motif FROM dna GROUP BY lang",
    "detect_alphabet": _PROTEIN + "SELECT doc_id, CASE WHEN regexp_full_match(s, '[ACGTNacgtn]*') THEN 'DNA' WHEN regexp_full_match(s, '[ACGUNacgun]*') THEN 'RNA' ELSE 'Protein' END AS result FROM protein",
    "validate": _PROTEIN + "SELECT doc_id, regexp_full_match(s, '[ACGTNacgtn]*') AS is_dna, TRUE AS is_protein FROM protein",
    "sanitize": _PROTEIN + "SELECT doc_id, regexp_replace(s, '[^ACGTNacgtn]', 'N', 'g') AS result FROM protein",
    "length": _pick("length(s)::INT"),
    "subsequence": _pick("CASE WHEN length(s) >= 8 THEN substr(s, 3, 6) END"),
    "slice_step": _pick("coalesce(array_to_string(list_transform(range(0, length(s), 2), lambda i: substr(s, CAST(i + 1 AS BIGINT), 1)), ''), '')"),
    "slice_reverse": _pick("reverse(s)"),
    "char_at": _pick("CASE WHEN s <> '' THEN substr(s, length(s), 1) END"),
    "views": _DNA + "SELECT doc_id, 4 AS slid_start, 12 AS slid_end, 0 AS back_start, 8 AS back_end, 6 AS sized_end FROM dna WHERE length(s) >= 12",
    "gc_content": _pick(f"CASE WHEN s = '' THEN 0.0::DOUBLE ELSE {_n('GCgc')}::DOUBLE / length(s) * 100.0::DOUBLE END"),
    "gc_content_called": _pick(f"CASE WHEN {_n('ACGTUacgtu')} = 0 THEN 0.0::DOUBLE ELSE {_n('GCgc')}::DOUBLE / {_n('ACGTUacgtu')} * 100.0::DOUBLE END"),
    "count_bases": _DNA + f"SELECT doc_id, {_n('Aa')}::INT AS a, {_n('Cc')}::INT AS c, {_n('Gg')}::INT AS g, {_n('TtUu')}::INT AS t, (length(s) - {_n('AaCcGgTtUu')})::INT AS other FROM dna",
    "base_composition": _DNA + "SELECT doc_id, base, count(*)::INT AS n FROM (SELECT doc_id, unnest(string_split(s, '')) AS base FROM dna) WHERE base <> '' GROUP BY doc_id, base",
    "total_composition": _DNA + "SELECT lang, base, count(*) AS n FROM (SELECT lang, unnest(string_split(s, '')) AS base FROM dna) WHERE base <> '' GROUP BY lang, base",
    "find_byte": _pick("CAST(strpos(s, 'G') - 1 AS INT)"),
    "count_byte": _pick(_n("a") + "::INT"),
    "reverse": _pick("reverse(s)"),
    "complement": _pick("translate(s, 'ACGTacgt', 'TGCAtgca')"),
    "reverse_complement": _pick("reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))"),
    "complement_dna": _pick("translate(s, 'ACGTUNacgtun', 'TGCAANTGCAAN')"),
    "reverse_complement_dna": _pick("reverse(translate(s, 'ACGTUNacgtun', 'TGCAANTGCAAN'))"),
    "transcribe": _pick("translate(s, 'Tt', 'Uu')"),
    "reverse_transcribe": _pick("s"),
    "find_all": _DNA + f"SELECT doc_id, unnest({_find('ata')})::INT AS position FROM dna",
    "count": _pick(f"len({_find('ata')})::INT"),
    "kmp_search": _pick(f"coalesce(array_to_string({_find('tion')}, ','), '')"),
    "long_search": _DNA + f"SELECT doc_id, unnest({_find('tnt')})::INT AS position FROM dna",
    "mask": _pick("CASE WHEN length(s) > 3 THEN 'N' || substr(s, 2, 2) || 'N' || substr(s, 5) END"),
    "concatenate": _DNA + "SELECT a.doc_id, a.s || b.s AS result FROM dna a JOIN dna b ON b.doc_id = a.doc_id + 1",
    "molecular_weight": _PROTEIN + "SELECT doc_id, round(CASE WHEN s = '' THEN 0.0 ELSE 18.015::DOUBLE" + "".join(f" + {_n(c + c.lower())} * {m}::DOUBLE" for c, m in S.RESIDUE_MASSES.items()) + " END, 2) AS result FROM protein",
    "pack_protein": _PROTEIN + "SELECT doc_id, translate(upper(s), 'STWYV*', 'XXXXXX') AS result, CAST((length(s) + 1) // 2 AS INT) AS n_bytes FROM protein",
    "pack_dna": _DNA + "SELECT doc_id, coalesce(array_to_string(list_transform(range(0, (length(s) + 3) // 4), lambda b: upper(printf('%02x', CAST(list_sum(list_transform(range(0, 4), lambda j: greatest(strpos('CGT', upper(substr(s || '', CAST(4 * b + j + 1 AS BIGINT), 1))) * CASE WHEN 4 * b + j < length(s) THEN 1 ELSE 0 END, 0) * CAST(4 ** (3 - j) AS INT))) AS INT)))), ''), '') AS data, translate(upper(s), 'N', 'A') AS result FROM dna",
    "pack_dna_expr": _DNA + "SELECT doc_id, coalesce(array_to_string(list_transform(range(0, (length(s) + 3) // 4), lambda b: upper(printf('%02x', CAST(list_sum(list_transform(range(0, 4), lambda j: greatest(strpos('CGT', upper(substr(s || '', CAST(4 * b + j + 1 AS BIGINT), 1))) * CASE WHEN 4 * b + j < length(s) THEN 1 ELSE 0 END, 0) * CAST(4 ** (3 - j) AS INT))) AS INT)))), ''), '') AS data, translate(upper(s), 'N', 'A') AS result FROM dna",
    "metadata": "WITH dna AS (SELECT doc_id, CASE WHEN lang <> 'en' THEN lang END AS d, regexp_replace(text, '[^ACGTNacgtn]', '', 'g') AS s FROM documents) SELECT doc_id, d || ' (reversed) (reverse complement) (transcribed)' AS description, translate(translate(s, 'ACGTacgt', 'TGCAtgca'), 'Tt', 'Uu') AS seq, 'RNA' AS alphabet FROM dna",
    "fasta_round_trip": _DNA + "SELECT doc_id, 'lang ' || lang AS description, s AS seq, 'DNA' AS alphabet FROM dna WHERE s <> ''",
    "fastq_round_trip": _DNA + "SELECT doc_id, lang AS description, s AS seq, repeat('I', length(s)) AS quality FROM dna",
    "parse_fasta": _DNA + "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS description, s AS seq FROM dna WHERE s <> ''",
    "parse_fastq": _DNA + "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS description, s AS seq, repeat('I', length(s)) AS quality FROM dna",
    "to_fasta": _pick(f"'>' || doc_id || ' ' || lang || chr(10) || CASE WHEN s = '' THEN '' ELSE {_wrap} || chr(10) END"),
    "edit_distance": _pick("levenshtein(s, reverse(s))::INT"),
    "random_dna": _pick("left(coalesce(array_to_string(list_transform(range(0, (length(s) + 63) // 64), lambda i: translate(sha256('7:' || doc_id || ':' || i), '0123456789abcdef', 'ACGTACGTACGTACGT')), ''), ''), length(s))"),
    "boyer_moore_search": _pick(f"coalesce(array_to_string({_find('tnta')}, ','), '')"),
    "mask_column": _pick("CASE WHEN s = '' THEN NULL WHEN length(s) = 1 THEN 'N' ELSE 'N' || substr(s, 2, length(s) - 2) || 'N' END"),
    "constructors": _PROTEIN + "SELECT doc_id, CASE WHEN regexp_full_match(s, '[ACGTNacgtn]*') THEN md5(translate(s, 'Tt', 'Uu')) END AS dna, CASE WHEN regexp_full_match(s, '[ACGTNacgtn]*') THEN md5(translate(s, 'Tt', 'Uu')) END AS rna, md5(s) AS protein, md5(s) AS any, md5(CASE WHEN regexp_full_match(s, '[ACGTNacgtn]*') THEN 'DNA' ELSE 'Protein' END) AS kind FROM protein",
    "rna": _DNA + f"SELECT doc_id, CASE WHEN s = '' THEN 0.0::DOUBLE ELSE {_n('GCgc')}::DOUBLE / length(s) * 100.0::DOUBLE END AS gc, TRUE AS valid, CASE WHEN regexp_matches(s, '[Tt]') THEN 'RNA' ELSE 'DNA' END AS alphabet, translate(translate(s, 'ACGTacgt', 'TGCAtgca'), 'Tt', 'Uu') AS complement, reverse(translate(translate(s, 'ACGTacgt', 'TGCAtgca'), 'Tt', 'Uu')) AS reverse_complement, s AS dna, translate(translate(s, 'ACGTacgt', 'TGCAtgca'), 'Tt', 'Uu') AS engine FROM dna",
    "small_parts": _DNA + "SELECT doc_id, s = '' AS empty, strlen(s)::INT AS n_bytes, s = reverse(s) AS palindrome, substr(s, 6, 20) AS clamped, length(regexp_replace(substr(s, 5, 36), '[^a]', '', 'g'))::INT AS in_view FROM dna",
    "records": _DNA + "SELECT doc_id, length(s)::INT AS n, lang, CAST(NULL AS VARCHAR) AS date FROM dna",
    "detect_format": _DNA + "SELECT unnest(['FASTA', 'FASTQ']) AS written, unnest(['FASTA', 'FASTQ']) AS detected, unnest([count(*) FILTER (s <> ''), count(*)]) AS n FROM dna",
    "append_fastq": _DNA + "SELECT doc_id, s AS seq, repeat('#', length(s)) AS quality FROM dna",
    "process_file": _DNA + "SELECT count(*) AS n_records FROM dna",
    "identity": _pick("CASE WHEN s = '' THEN 0.0::DOUBLE ELSE round(100.0::DOUBLE * len(list_filter(range(0, length(s)), lambda i: substr(s, CAST(i + 1 AS BIGINT), 1) = substr(s, CAST(length(s) - i AS BIGINT), 1))) / length(s), 9) END"),
    "to_fasta_wide": _pick("'>' || doc_id || chr(10) || CASE WHEN s = '' THEN '' ELSE rtrim(regexp_replace(s, '(.{17})', '\\1' || chr(10), 'g'), chr(10)) || chr(10) END"),
    "to_fastq": _pick("'@' || doc_id || ' ' || lang || chr(10) || s || chr(10) || '+' || chr(10) || repeat('I', length(s)) || chr(10)"),
    "chunk_slice": _DNA + "SELECT doc_id, (i // 500)::INT AS chunk, substr(s, CAST(i + 1 AS BIGINT), 500) AS piece FROM (SELECT doc_id, s, unnest(range(0, length(s), 500)) AS i FROM dna)",
    "split_join": _DNA + "SELECT doc_id, translate(s, 'ACGTUNacgtun', 'TGCAANTGCAAN') AS result FROM dna WHERE s <> ''",
    "map_items": _pick(f"CAST({_n('A')} + 2 * {_n('t')} AS BIGINT)"),
    "map_chunks": _DNA + "SELECT chunk, sum(k * length(s))::BIGINT AS result FROM (SELECT CAST(doc_id // 100 AS BIGINT) AS chunk, s, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS k FROM dna) GROUP BY chunk",
    "file_chunks": "SELECT doc_id, i::INT AS start, least(i + 300, n_chars)::INT AS \"end\" FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars, 300)) AS i FROM documents)",
    "kmer_counts": _DNA + "SELECT kmer, count(*) AS n FROM (SELECT substr(s, CAST(i + 1 AS BIGINT), 3) AS kmer FROM (SELECT s, unnest(range(0, greatest(length(s) - 2, 0))) AS i FROM dna)) GROUP BY kmer",
}
