"""Domain tables derived from the driver's tables, in SQL that Spark and DuckDB both take.

The same text feeds the queries and their oracles, so that both start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ["part", "lineitem", "supplier", "nation", "orders"]

CTES = """
locus as (
  select p_partkey, concat('chr', p_partkey % 24 + 1) chrom,
         case when p_partkey % 2 = 0 then '+' else '-' end strand,
         cast(floor(p_partkey / 24) as int) * 500 + 481 base, p_size, p_type,
         translate(concat(md5(cast(p_partkey as string)), md5(concat('g', p_partkey))),
                   '0123456789abcdef', 'ACGTACGTACGTACGT') seq64
  from part),
anno as (
  select chrom, strand, base + 20 + shift anno_start, base + 36 + p_size + shift anno_end,
         concat('ncrna-', p_partkey, '-', fam) anno_name, p_partkey + fam * 1000000 aid,
         case (ascii(p_type) + p_partkey * fam) % 6 when 0 then 'mirna' when 1 then 'mirna' when 2 then 'tRf'
              when 3 then 'piRNA' when 4 then 'RFam' else 'lncRNA' end species
  from locus cross join (select * from (values (0, 0), (1, 1), (2, -1)) t(fam, shift)) f
  where fam <= p_partkey % 3),
prio as (
  select * from (values ('mirna', 0), ('tRf', 1), ('piRNA', 2), ('rRNA', 3), ('SNORNA', 4),
                        ('URNA', 5), ('Y_RNA', 6), ('RFam', 7)) v(species, rnk)),
raw_reads as (
  select l_orderkey, l_suppkey, l_partkey pk, l_linenumber ln, l_returnflag rf, l_quantity,
         case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end k,
         case when l_suppkey % (2 + l_partkey % 4) = 0 then 0 else l_suppkey % 3 end jit
  from lineitem),
grp as (
  select pk, ln, rf, k, jit, cast(sum(cast(l_quantity as int)) as bigint) abundance
  from raw_reads group by pk, ln, rf, k, jit),
pos0 as (
  select g.*, l.chrom, l.strand, l.base, l.seq64,
         case when l.strand = '+' then l.base + ln + 16 else l.base + 20 - jit - k end read_start,
         case when l.strand = '+' then l.base + 41 + jit + k else l.base + 44 - ln end read_end
  from grp g join locus l on l.p_partkey = g.pk),
al0 as (
  select *, cast(read_end - read_start + 1 as int) len,
         substr(seq64, cast(read_start - base + 1 as int), cast(read_end - read_start + 1 as int)) ref_seq
  from pos0),
aln as (
  select concat(pk, '.', ln, '.', rf, '.', jit, '|', abundance) read_id, pk, ln, rf, jit, k, abundance, chrom, strand,
         read_start, read_end, len, k nm, ref_seq,
         case when strand = '+'
              then concat(left(ref_seq, len - k), translate(right(ref_seq, k), 'ACGT', 'CATG'))
              else concat(translate(left(ref_seq, k), 'ACGT', 'CATG'), right(ref_seq, len - k)) end seq,
         case when k = 0 then cast(len as string)
              when strand = '+' and k = 1 then concat(len - 1, right(ref_seq, 1), '0')
              when strand = '+' then concat(len - 2, left(right(ref_seq, 2), 1), '0', right(ref_seq, 1), '0')
              when k = 1 then concat('0', left(ref_seq, 1), len - 1)
              else concat('0', left(ref_seq, 1), '0', right(left(ref_seq, 2), 1), len - 2) end md
  from al0),
nte as (
  select a.*, case when k = 0 then '0' when strand = '+' then right(seq, k)
                   else reverse(translate(left(seq, k), 'ACGT', 'TGCA')) end nte3,
         case when k = 0 then null when strand = '+' then right(ref_seq, k)
              else reverse(translate(left(ref_seq, k), 'ACGT', 'TGCA')) end nte3_ref
  from aln a),
fastq as (
  select concat(l_orderkey, '-', r.pk, '-', l_suppkey) name,
         case when n.strand = '+' then n.seq else reverse(translate(n.seq, 'ACGT', 'TGCA')) end seq,
         translate(substr(md5(concat(l_orderkey, '-', r.pk, '-', l_suppkey)), 1, n.len),
                   '0123456789abcdef', '5:?@ABCDEFGHIIII') qual
  from raw_reads r join nte n on n.pk = r.pk and n.ln = r.ln and n.rf = r.rf and n.jit = r.jit),
psl as (
  select concat(l_orderkey, '|1') q_name, cast(l_quantity as int) matches, l_linenumber mismatches,
         case l_returnflag when 'R' then 1 else 0 end q_num_insert, case l_linestatus when 'O' then 1 else 0 end t_num_insert,
         concat('chr', l_partkey % 24 + 1) t_name, l_partkey * 3 t_start, l_partkey * 3 + 22 t_end,
         l_linenumber % 3 q_start, 22 - l_suppkey % 2 q_end, 22 q_size
  from lineitem),
rmsk as (
  select concat('chr', s_suppkey % 24 + 1) chrom, (s_suppkey * 1571) % 41000 start0, (s_suppkey * 1571) % 41000 + 600 end0 from supplier),
snp as (
  select distinct l.chrom, l.base + 20 + o.o_custkey % 30 pos,
         case o.o_orderstatus when 'F' then 'A' when 'O' then 'C' else 'G' end ref,
         case o.o_orderpriority when '5-LOW' then 'T' else 'C' end alt
  from orders o join locus l on l.p_partkey = o.o_orderkey),
smod as (
  select n_regionkey grp, s_nationkey sample, l_partkey % 200 aid, l_linenumber % 3 mod_type,
         l_linenumber + 16 pos, substr('ACGT', cast(l_partkey % 200 % 4 + 1 as int), 1) ref,
         case l_linenumber when 1 then 'A' when 2 then 'T' when 3 then 'AT' when 4 then 'G' when 5 then 'GCA' when 6 then 'N' else 'CCCC' end alt,
         cast(sum(cast(l_quantity as int)) as bigint) cnt
  from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey
  group by n_regionkey, s_nationkey, l_partkey % 200, l_linenumber)"""

#: Second-aligner hits of the annotated reads ``ann``.
BLAT = """  select read_id, chrom, '+' strand, read_start full_start, read_end full_end, 1 ordinal from ann where (pk + ln) % 7 in (0, 1, 2, 5, 6)
  union all
  select read_id, chrom, '+' strand, read_start + 40 full_start, read_end + 40 full_end, 2 ordinal from ann where (pk + ln) % 7 in (2, 3)
  union all
  select read_id, concat(chrom, 'x') chrom, '-' strand, read_start + 9 full_start, read_end + 9 full_end, 0 ordinal from ann where (pk + ln) % 7 = 3"""

#: Further tables: alignments with one annotation, the mirror image (5' instead of 3' modifications), second-aligner
#: hits of the annotated reads, and per-annotation modification counts of one sample.
MORE = """,
hit as (
  select r.read_id, a.anno_name, a.anno_start, a.anno_end, a.species, a.aid,
         row_number() over (partition by r.read_id order by coalesce(p.rnk, 99), a.aid) rn
  from aln r join anno a on r.chrom = a.chrom and r.strand = a.strand
   and (case when a.anno_end - a.anno_start + 1 > 50
             then r.read_start >= a.anno_start - 3 and r.read_end <= a.anno_end + 3
             else abs(r.read_start - a.anno_start) <= 3 and abs(r.read_end - a.anno_end) <= 3 end)
  left join prio p on p.species = a.species),
ann as (
  select n.read_id, n.pk, n.ln, n.abundance, n.chrom, n.strand, n.read_start, n.read_end, n.nte3, n.nte3_ref, n.k, n.nm, n.md, n.seq, n.len,
         h.anno_name, h.anno_start, h.anno_end, h.species, h.aid,
         case when k = 0 then null when n.strand = '+' then n.read_end - k + 1 else n.read_start + k - 1 end p_from,
         case when k = 0 then null when n.strand = '+' then n.read_end else n.read_start end p_to
  from nte n join hit h on h.read_id = n.read_id and h.rn = 1),
mirror as (
  select read_id, abundance, chrom, case strand when '+' then '-' else '+' end strand, read_start, read_end, md, nm, seq, k,
         case when k = 0 then null when strand = '+' then reverse(translate(right(seq, k), 'ACGT', 'TGCA')) else left(seq, k) end nte5,
         case when k = 0 then null when strand = '+' then reverse(translate(right(ref_seq, k), 'ACGT', 'TGCA')) else left(ref_seq, k) end nte5_ref
  from aln),
blat as (
""" + BLAT + """),
judged as (
  select a.*, case when h.n is null then 'NO_BLAT_RESULT' when h.same = 1 and h.n > 1 then 'SAME-MULTIMAPP' when h.same = 1 then 'CORRECT'
                   when h.n > 1 then 'DIFF-MULTIMAPP' else 'DIFF-UNIQ' end consensus
  from ann a left join (
    select a.read_id, count(*) n, max(case when b.chrom = a.chrom and b.strand = '+' and b.full_start = a.read_start and b.full_end = a.read_end then 1 else 0 end) same
    from ann a join blat b on a.read_id = b.read_id group by a.read_id) h on h.read_id = a.read_id
  where a.species = 'mirna'),
mods as (
  select anno_name, aid, chrom, strand, p_from, p_to, nte3_ref ref, nte3 alt, cast(sum(abundance) as bigint) n
  from ann where k > 0 group by anno_name, aid, chrom, strand, p_from, p_to, nte3_ref, nte3),
stretch as (
  select o_orderkey sid, concat('chr', o_custkey % 24 + 1) chrom, (o_orderkey * 7919) % 3000000 + 1 low,
         (o_orderkey * 7919) % 3000000 + case when o_orderkey % 1000 = 0 then 5000000 when o_orderkey % 100 = 1 then 300000
                                              when o_orderkey % 50 = 2 then 20000 else 20 + o_orderkey % 400 end high
  from orders),
spot as (
  select p_partkey pid, concat('chr', p_partkey % 24 + 1) chrom, (p_partkey * 104729) % 3000000 + 1 low,
         (p_partkey * 104729) % 3000000 + 18 + p_size high from part),
tips as (
  select concat('m', p_partkey) anno_name, p_partkey % 3 mod_type, chrom, strand, k,
         base + 40 + case when strand = '+' then 0 else k - 1 end p_from, base + 40 + case when strand = '+' then k - 1 else 0 end p_to,
         case when strand = '+' then substr(seq64, 41, k) else reverse(translate(substr(seq64, 41, k), 'ACGT', 'TGCA')) end ref, n
  from (select *, case when p_partkey % 3 = 2 then 1 else 2 + p_partkey % 2 end k, cast(p_size as bigint) n from locus) l),
variant as (
  select distinct chrom, base + 40 + o pos, substr(seq64, cast(41 + o as int), 1) ref, translate(substr(seq64, cast(41 + o as int), 1), 'ACGT', 'CATG') alt
  from (select chrom, base, seq64, cast(floor(p_partkey / 5) as int) % 3 o from locus where p_partkey % 4 <> 0
        union all select chrom, base, seq64, cast(floor(p_partkey / 11) as int) % 3 o from locus where p_partkey % 7 = 0) v)"""


#: Joins of which Spark's estimate knows the file of parts but not the texts made of them, so that it would send them all.
#: A part's few alignments lie together already: raw reads go to them by ``pk`` alone, the rest of their key as ranges.
HINTS = {
    "select g.*, l.chrom": "select /*+ merge(l) */ g.*, l.chrom",
    "from raw_reads group by pk": "from (select /*+ repartition(pk) */ * from raw_reads) x group by pk",
    "select distinct l.chrom, l.base + 20": "select /*+ merge(l) */ distinct l.chrom, l.base + 20",
    "on n.pk = r.pk and n.ln = r.ln and n.rf = r.rf and n.jit = r.jit": "on n.pk = r.pk and n.ln between r.ln and r.ln and n.rf between r.rf and r.rf and n.jit between r.jit and r.jit",
}


def _hinted(sql: str) -> str:
    """The same SQL with hints to Spark; reads are counted where they are joined, by ``pk``, in one shuffle for both."""
    for plain, hinted in HINTS.items():
        sql = sql.replace(plain, hinted)
    return sql


def bridge(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One derived table; only the base tables and columns that it needs are read.  No view is registered."""
    base = ", ".join(f"{name} as (select * from parquet.`{sf_dir}/{name}.parquet`)" for name in BASE)
    made = spark.sql(f"with {base}, {_hinted(CTES)} {MORE} select * from {table}")
    # Domain tables would be stored ones.  Without this step the optimizer writes their long expressions into every
    # use of a column, and the generated methods grow beyond what the JVM compiles.
    return _cut(made)


def _cut(made: DataFrame) -> DataFrame:
    return made.select(F.explode(F.array(F.struct(*[F.col(c) for c in made.columns]))).alias("row")).select("row.*")


def second_hits(ann: DataFrame) -> DataFrame:
    """The table ``blat`` of annotated reads that are given.  ``bridge(spark, d, "blat")`` would find them by ``hit``, whose
    join knows chromosome and strand alone, so that it grows with the square of the tables."""
    return _cut(ann.sparkSession.sql(BLAT.replace("from ann ", "from {ann} "), ann=ann))


def oracle(sql: str) -> str:
    return f"with {CTES} {MORE}\n{sql}"
