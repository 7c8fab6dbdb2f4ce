"""One query for each operator, over its whole table, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm import conversation_repair, decontamination, golay_simhash, html_text, line_dedup, lm_scoring, ngram_join, packing, quality_rules, resampling, token_files, warc, whitening
from quarterdeck.llm.shared import shared_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    folder = shared_folder(spark)
    index = written(warc.write_warc(warc.with_revisits(table(spark, sf_dir, "pages")), f"{folder}/archives"), f"{folder}/index")
    rows = warc.read_warc(spark, f"{folder}/archives", index)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_FOUR = "lpad(to_base(cast('0x' || substr(hex, {}, 5) as bigint), 32), 4, '0')"  # five hexadecimal digits in base 32

ORACLES["op3_warc"] = f"""
with own as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), coded as (
  select page_id, payload_bytes, hex, translate(
    {" || ".join(_FOUR.format(1 + 5 * k) for k in range(8))},
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest,
    max(page_id) over (partition by hex) as largest
  from own
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when page_id = largest then 'response' else 'revisit' end as record_type,
  case when page_id = largest then null else largest end as refers_to
from coded
"""


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to token files and read back."""
    folder = shared_folder(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, vocabulary("byte_bpe_50k.json"), 2)
    return token_files.token_digests(token_files.read_token_files(spark, folder))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages that stand earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


ORACLES["op10_line_dedup"] = r"""
with docs as (select distinct doc_id, text from documents where text is not null),
cut as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from docs
), worded as (
  select *, row_number() over (partition by doc_id, text order by pos) as k from cut where regexp_matches(line, '[^\x20\x09-\x0D]')
), windows as (
  select a.doc_id, a.text, a.pos as first, c.pos as last, a.line as l1, b.line as l2, c.line as l3
  from worded a join worded b on a.doc_id = b.doc_id and a.text = b.text and b.k = a.k + 1
  join worded c on a.doc_id = c.doc_id and a.text = c.text and c.k = a.k + 2
), ranked as (
  select *, row_number() over (partition by l1, l2, l3 order by doc_id, first) as r from windows
), kept as (
  select c.doc_id, c.text, c.line, c.pos,
    exists (select 1 from ranked w where w.r > 1 and w.doc_id = c.doc_id and w.text = c.text and c.pos between w.first and w.last) as gone
  from cut c
), made as (
  select doc_id, text, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as clean, count(*) as n_lines,
    count(*) filter (where gone) as n_removed
  from kept group by doc_id, text
)
select d.doc_id, case when d.text is null then null else m.clean end as text, coalesce(m.n_lines, 0) as n_lines, coalesce(m.n_removed, 0) as n_removed
from documents d left join made m on d.doc_id = m.doc_id and d.text = m.text
"""


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that stand in documents, a row a pair."""
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_shingles", "shared_shingles")


ORACLES["op1_decontamination"] = r"""
with cut as (
  select 'd' as kind, doc_id as id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from (select distinct doc_id, text from documents)
  union all
  select 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') from benchmark
), shingles as (
  select distinct kind, id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))
    else [array_to_string(w, ' ')] end) as s
  from cut where len(w) > 0
), sizes as (select id, count(*) as n from shingles where kind = 'i' group by id)
select d.id as doc_id, i.id as item_id, any_value(n) as item_shingles, count(*) as shared_shingles
from shingles d join shingles i on d.kind = 'd' and i.kind = 'i' and d.s = i.s join sizes on sizes.id = i.id
group by d.id, i.id having count(*) >= 0.75 * any_value(n)
"""


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of linked documents that each document is in."""
    return ngram_join.linked_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's statistics and whether it is kept."""
    held = quality_rules.judged(table(spark, sf_dir, "documents"))
    return held.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op6_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling takes."""
    taken = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return taken.select("doc_id", "n_features", "log_weight", "key", F.lit(True).alias("kept"))


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' log-likelihoods."""
    return lm_scoring.scored(table(spark, sf_dir, "documents"))


@query
def op11_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the component of linked fingerprints that it is in."""
    return golay_simhash.near_copies(table(spark, sf_dir, "documents"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable vector on the leading 32 whitened components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's faults after damage, and its cheapest repair."""
    return conversation_repair.repaired(table(spark, sf_dir, "conversations"))


def _repair_sql() -> str:
    """The cheapest edits by recursion from each conversation's last row: a value is [cost, audit, repaired rows], least first."""
    after = {0: "user", 1: "user", 2: "assistant", 3: "user"}  # state: the role that may come next
    state = {"user": 2, "assistant": 3}
    keeps = {0: "case initial when 's' then b1 when 'u' then b2 end", 1: "case initial when 'u' then b2 end", 2: "case initial when 'a' then b3 end", 3: "case initial when 'u' then b2 end"}

    def put(cost: str, letter: str, row: str, rest: str) -> str:
        return f"[lpad(cast(cast(({rest})[1] as bigint) + {cost} as varchar), 9, '0'), '{letter}' || ({rest})[2], {row} || ({rest})[3]]"

    def option(q: int) -> str:
        late, keep, follow = "case when truncated then 3 else 0 end", f"({keeps[q]})", f"b{state[after[q]]}"
        kept = put(f"({late})", "K", "(chr(10) || role || ':' || text)", keep)
        named = put(f"(3 + {late})", "R", f"(chr(10) || '{after[q]}:' || text)", follow)
        return f"least({put('4', 'D', chr(39) * 2, f'b{q}')}, case when not must and {keep} is not null then {kept} end, case when not must then {named} end) as o{q}"

    def insert(q: int, rest: str) -> str:
        return put("3", "I", f"(chr(10) || '{after[q]}:')", rest)

    return f"""
with recursive crc_table as (
  select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab
), keyed as (
  select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as id from conversations
), hit as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce(
    list_concat([4294967295], list_transform(range(strlen(id)), lambda i: cast(ord(id[i + 1]) as bigint))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 as damage
  from keyed, crc_table
), hurt as (
  select conv_id, turn, case when damage = 4 then 'user' else role end as role,
    case damage when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when damage = 3 then 2 else 1 end)) as copy
  from hit where damage <> 0
), told as (
  select *, sha256(coalesce(cast(conv_id as varchar), ' ') || ':' || length(role) || ':' || role || text) as digest,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from hurt
), ranked as (
  select *, row_number() over (partition by conv_id order by turn nulls first, digest, copy) as k, left(role, 1) as initial,
    row_number() over (partition by conv_id, digest order by turn nulls first, copy) > 1 as again from told
), faulty as (
  select conv_id, turn, role, text, k, initial, bare = '' as blank, bare <> '' and again as duplicate,
    bare <> '' and not again and right(bare, 1) not in ('.', '!', '?') as truncated, bare = '' or again as must,
    lag(initial) over (partition by conv_id order by k) || initial as pair, count(*) over (partition by conv_id) as n
  from ranked
), counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank,
    count(*) filter (where duplicate) as duplicate, count(*) filter (where truncated) as truncated,
    count(*) filter (where k > 1 and pair not in ('su', 'ua', 'au')) as illegal
  from faulty group by conv_id
), walk as (
  select conv_id, n as k, ['000000000', '', ''] as b0, ['000000006', 'II', chr(10) || 'user:' || chr(10) || 'assistant:'] as b1,
    ['000000003', 'I', chr(10) || 'assistant:'] as b2, ['000000000', '', ''] as b3
  from faulty where k = n
  union all
  select conv_id, k, least(o0, {insert(0, "f2")}) as b0, least(o1, {insert(1, "f2")}) as b1, f2 as b2, least(o3, {insert(3, "f2")}) as b3
  from (
    select *, least(o2, {insert(2, "o3")}) as f2 from (
      select f.conv_id, f.k - 1 as k, {option(0)}, {option(1)}, {option(2)}, {option(3)}
      from walk w join faulty f on f.conv_id is not distinct from w.conv_id and f.k = w.k
    )
  )
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cast(b0[1] as bigint), 0) as cost, coalesce(b0[2], '') as audit, sha256(coalesce(b0[3][2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counts n on n.conv_id is not distinct from c.conv_id
left join walk w on w.conv_id is not distinct from c.conv_id and w.k = 0
"""


ORACLES["op13_conversation_repair"] = _repair_sql()
