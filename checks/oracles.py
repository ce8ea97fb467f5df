"""SQL statements with the same results as the queries, for DuckDB.

They are written from the definitions, with other means than the Spark side where
possible: consuming groups for look-around, chained replacements for one-pass
lookups, recursion for the subsequence table.
"""

from __future__ import annotations

import math

from opinionmill.functions.contractions import CONTRACTIONS
from opinionmill.functions.language import PROFILES
from opinionmill.functions.prompts import COMPONENT_PROMPT, QUAD_PROMPT
from opinionmill.operators import language_model as M

from . import inputs as I

W = r"\p{L}\p{N}_"
S = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
S_IN = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
EMOJI = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}"
    r"\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}"
)
KEPT = W + S_IN + r""".,;:!?/"\-"""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return rx(x, rf"\A{S}+|{S}+\z", "")


def collapse(x: str) -> str:
    return strip(rx(x, f"{S}+", " "))


def punct(x: str) -> str:
    return rx(x, rf"{S}+([.,;:!?])", r"\1")


def digits(x: str) -> str:
    return rx(x, r"(\p{Nd})([A-Za-z])", r"\1 \2")


def sentences(x: str) -> str:
    return rx(x, "([.!?])([A-Z])", r"\1 \2")


def capitalise(x: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = rx(x, f"([.!?]){S}+{c}", rf"\1 {c.upper()}")
    return x


def symbols(x: str) -> str:
    return rx(x, f"(^|[{KEPT}])[^{KEPT}{EMOJI}][^{KEPT}]*", r"\1")


def tags(x: str) -> str:
    return rx(x, r"<[^\n]*?>", " ")


def contractions(x: str) -> str:
    for short, full in CONTRACTIONS.items():
        # Twice: neighbouring matches share the character between them.
        for _ in range(2):
            x = rx(x, f"(^|[^{W}]){short}($|[^{W}])", rf"\1{full}\2")
    return x


_ONE = r"[\x00-\x7f]|[\x{c2}-\x{df}]C|\x{e0}[\x{a0}-\x{bf}]C|[\x{e1}-\x{ec}\x{ee}\x{ef}]CC|\x{ed}[\x{80}-\x{9f}]C"
_FOUR = r"|\x{f0}[\x{90}-\x{bf}]CC|[\x{f1}-\x{f3}]CCC|\x{f4}[\x{80}-\x{8f}]CC"
UTF8 = f"(?:{_ONE}{_FOUR})*".replace("C", r"[\x{80}-\x{bf}]")


def mojibake(x: str) -> str:
    return (
        f"case when regexp_full_match({x}, {q(UTF8)}) and regexp_matches({x}, {q(r'[\x{80}-\x{ff}]')}) then "
        f"decode(unhex(array_to_string(list_transform(string_split({x}, ''), lambda c: printf('%02x', unicode(c))), ''))) "
        f"else {x} end"
    )


def entities(x: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', {q(char)})"
    return x


def noisy(noise: str) -> str:
    return f"{q(noise)} || text || {q(noise)}"


def step(fn, noise: str = I.NOISE) -> str:
    return f"with n as (select doc_id, {noisy(noise)} as t from documents) select doc_id, {fn('t')} as text from n"


def clean_ctes(source: str) -> str:
    """CTEs ``s0..s5`` from a relation ``source(id, t)``; the result is ``s5``."""
    return f"""
    s0 as materialized (select id, {entities(strip('t'))} as t from {source}),
    s1 as materialized (select id, {mojibake('t')} as t from s0),
    s2 as materialized (select id, {contractions(tags('t'))} as t from s1),
    s3 as materialized (select id, {sentences(digits(punct(collapse('t'))))} as t from s2),
    s4 as materialized (select id, {capitalise('t')} as t from s3),
    s5 as materialized (select id, {strip(symbols('t'))} as t from s4)"""


def ngram_ctes() -> str:
    """``grams``: the bucket of every n-gram of the documents; ``letters``: the script of every letter."""
    script = "case " + " ".join(
        f"when c >= {first} then {M.SCRIPT_NAMES.index(name)}" for first, name in reversed(M.SCRIPTS)
    ) + " else 0 end"
    grams = " union all ".join(
        f"select doc_id, lang, split, ({n * M.STEP} + " + " + ".join(f"c[i + {k}] * {M.FACTORS[k]}" for k in range(n))
        + f") % {M.BUCKETS} as place from (select *, unnest(range(1, len(c) - {n - 2})) as i from coded)" for n in M.LENGTHS
    )
    return rf"""
    lettered as (select doc_id, lang, case when b < 8 then 'train' when b = 8 then 'validation' else 'test' end as split,
                        trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) as t
                 from (select *, ('0x' || substr(md5('42:REV' || doc_id), 1, 8))::bigint % 10 as b from documents)),
    coded as (select doc_id, lang, split, list_transform(string_split(' ' || t || ' ', ''), lambda x: unicode(x)::bigint) as c
              from lettered where t <> ''),
    grams as ({grams}),
    letters as (select doc_id, lang, split, {script} as place
                from (select doc_id, lang, split, unnest(c) as c from coded) where c <> 32)"""


def identified_ctes() -> str:
    return ngram_ctes() + f""",
    counted as (select lang, place, count(*) as n from grams where split = 'train' group by all),
    sums as (select lang, sum(n) as n from counted group by lang),
    weights as (select s.lang, p.place, round(ln((coalesce(c.n, 0) + 0.5) / (s.n + 0.5 * {M.BUCKETS})) * {M.SCALE})::bigint as w
                from sums s cross join range({M.BUCKETS}) as p(place) left join counted c on c.lang = s.lang and c.place = p.place),
    known as (select lang, place from letters where split = 'train'
              group by lang, place qualify count(*) / {M.SCRIPT_SHARE} >= sum(count(*)) over (partition by lang)),
    main as (select doc_id, place from letters group by doc_id, place
             qualify row_number() over (partition by doc_id order by count(*) desc, place) = 1),
    held as (select doc_id, place, count(*) as n from grams group by all),
    scores as (select h.doc_id, w.lang, sum(h.n * w.w)::bigint as score from held h join weights w using (place)
               where exists (select 1 from main m join known k using (place) where m.doc_id = h.doc_id and k.lang = w.lang) group by all),
    best as (select doc_id, max(score) - max(score, 2)[2] as lead, arg_max(lang, score) as lang, count(*) as n from scores group by doc_id),
    identified as (select l.doc_id, l.lang, l.split, b.lead,
                          case when b.n = 1 or b.lead >= {M.SCALE} then b.lang else 'unknown' end as language
                   from lettered l left join best b using (doc_id))"""


def language_ctes() -> str:
    rows = ", ".join(f"({q(lang)}, {q(w)})" for lang, words in PROFILES.items() for w in dict.fromkeys(words))
    return rf"""
    profile(language, w) as (values {rows}),
    words as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) as w from documents),
    hits as (select doc_id, language, count(*) as n from words join profile using (w) group by all),
    best as (select doc_id, max(n) as n from hits group by doc_id),
    winner as (select h.doc_id, case when count(*) = 1 then min(language) else 'unknown' end as language
               from hits h join best b on h.doc_id = b.doc_id and h.n = b.n group by h.doc_id),
    detected as (select d.doc_id, d.text, coalesce(w.language, 'unknown') as language
                 from documents d left join winner w using (doc_id))"""


def trimmed(pieces: str) -> str:
    return f"list_filter(list_transform({pieces}, lambda s: {strip('s')}), lambda s: s <> '')"


SEGMENT = rf"[.!?;]+|,?(?:{S}+(?:but|and|while|although))+{S}+"
SEGMENTS = f"{trimmed(f'regexp_split_to_array(text, {q(SEGMENT)})')}"
MARKED = trimmed("string_split(replace(text, '.', ';'), ';')")
EXPLODED = """
    (select {id}, unnest(range(len(parts)))::int as pos, unnest(parts) as component from
        (select {id}, {parts} as parts from {source}))"""


def exploded(parts: str, source: str = "documents", id: str = "doc_id") -> str:
    return EXPLODED.format(id=id, parts=parts, source=source)


KEYED = "select conv_id, turn, text, 'REV' || conv_id as review_key from conversations"
RANKED = f"""
    keyed as ({KEYED}),
    ids as (select distinct review_key from keyed),
    placed as (select review_key, row_number() over (order by md5('42:' || review_key) || ':' || review_key) as place,
                      count(*) over () as n from ids),
    cut as (select *, ceil(0.2 * n) as held from placed),
    labelled as (select review_key, case when place <= n - held then 'train'
                        when place <= n - ceil(0.5 * held) then 'validation' else 'test' end as split from cut)"""

TOKEN = rf"[{W}]+|[^{W}{S_IN}]"
VOCABULARY = f"""
    tokens as (select unnest(regexp_extract_all(text, {q(TOKEN)})) as token from documents),
    counted as (select token, count(*) as n from tokens group by token),
    vocabulary as (select token, n, (row_number() over (order by n desc, token) + 1)::int as token_id from counted
                   qualify row_number() over (order by n desc, token) <= {I.VOCABULARY_SIZE})"""


def encoded(text: str, limit: int | None = None, source: str = "documents", id: str = "doc_id") -> str:
    cut = f"[1:{limit}]" if limit else ""
    return f"""
    (select {id}, coalesce(list(coalesce(token_id, 1) order by k) filter (token is not null), []) as ids from
        (select {id}, unnest(range(len(w))) as k, unnest(w) as token from
            (select {id}, regexp_extract_all({text}, {q(TOKEN)}){cut} as w from {source}))
        left join vocabulary using (token) group by {id})"""


def text_of(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


_QUAD = (
    "'aspect: ' || p_type || ', aspect term: ' || p_name || ', ' || p_brand || ', opinion term: ' || p_brand"
    " || ' , sentiment: ' || p_name || '!'"
)
QUAD_TEXT = f"""
    quad_texts as (select p_partkey,
        case when p_size < 5 then replace({_QUAD}, 'sentiment:', 'sentiment') when p_size < 10 then replace({_QUAD}, ',', '')
             when p_size < 12 then '' else {_QUAD} end as s from part)"""
MARKERS = (("aspect", "aspect:"), ("aspect_term", "aspect term:"), ("opinion_term", "opinion term:"), ("sentiment", "sentiment:"))
COMPLETE = " and ".join(f"contains(s, '{m}')" for _, m in MARKERS)


def _between(marker: str, end: str | None) -> str:
    piece = f"string_split(s, '{marker}')[2]"
    return strip(f"string_split({piece}, '{end}')[1]" if end else piece)


def parser(ends: tuple[str | None, ...]) -> str:
    fields = ", ".join(
        f"case when {COMPLETE} then {_between(m, e)} end as {f}" for (f, m), e in zip(MARKERS, ends)
    )
    return f"with {QUAD_TEXT} select p_partkey, {fields} from quad_texts"


_STRICT = [(f, rf"{m}{S}*([^\n]*?),") for f, m in MARKERS[:3]] + [("sentiment", rf"sentiment:{S}*([{W}]+)")]
STRICT_OK = " and ".join(f"regexp_matches(s, {q(p)})" for _, p in _STRICT)

LABELLED = """
    w as (select d.doc_id, d.lang, l.quality, l.toxic, regexp_extract_all(lower(d.text), '[a-z]+') as w
          from documents d join labels l using (doc_id)),
    labelled as (select doc_id,
        array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when length(w[i]) = 5
            then w[i] || case when length(w[i + 1]) = 2 then ' ' || w[i + 1] else '' end end), lambda x: x is not null), ', ') as term,
        case lang when 'en' then 'Story' when 'fr' then 'Acting' else 'Movie' end as aspect,
        array_to_string(list_filter(w, lambda x: length(x) = 6), ', ') as opinion,
        case when toxic = 1 then 'negative' when quality = 1 then 'positive' else 'neutral' end as sentiment from w)"""
WORDS = f"[{W}]+"


def _phrases(column: str) -> str:
    return (
        f"list_transform(string_split({column}, ','), "
        f"lambda t: array_to_string(regexp_extract_all(lower(t), {q(WORDS)}), ' '))"
    )


LEXICON = f"""{LABELLED},
    terms as (
        select 'aspect' as kind, unnest({_phrases('term')}) as phrase, aspect as label from labelled union all
        select 'opinion', unnest({_phrases('opinion')}), sentiment from labelled),
    term_counts as (select kind, phrase, label, count(*) as support from terms
                    where phrase not in ('', 'null') group by all),
    lexicon as (select * from term_counts
                qualify row_number() over (partition by kind, phrase order by support desc, label) = 1)"""
LABELLED_PARTIAL = LEXICON.replace("labelled as (", "whole as (", 1).replace(
    "terms as (",
    "labelled as (select doc_id, case when aspect <> 'Acting' then term end as term, aspect, "
    "case when aspect <> 'Story' then opinion end as opinion, sentiment from whole),\n    terms as (",
    1,
)
#: P(X <= k) of a Poisson variable of mean 1, k from 0.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(11)]
PREDICTED = f"""{LEXICON},
    component as {exploded(SEGMENTS)},
    cw as (select doc_id, pos, component, regexp_extract_all(lower(component), {q(WORDS)}) as w from component),
    sized as (select *, unnest([1, 2, 3, 4]) as n from cw),
    spans as (select doc_id, pos, w, n, unnest(range(1, len(w) - n + 2)) as k from sized),
    grams as (select doc_id, pos, n, k, array_to_string(w[k:k + n - 1], ' ') as phrase from spans),
    matched as (select doc_id, pos, kind, first(phrase order by n desc, k) as phrase,
                       first(label order by n desc, k) as label
                from grams join lexicon using (phrase) group by all),
    predicted as (select c.doc_id, c.pos, c.component,
        coalesce(a.label, 'Movie') as aspect, coalesce(a.phrase, 'NULL') as aspect_term,
        coalesce(o.phrase, 'NULL') as opinion_term, coalesce(o.label, 'neutral') as sentiment
        from component c
        left join matched a on a.doc_id = c.doc_id and a.pos = c.pos and a.kind = 'aspect'
        left join matched o on o.doc_id = c.doc_id and o.pos = c.pos and o.kind = 'opinion')"""

TURNS = """
    predictions as (select conv_id || '-' || turn as row_id, text as prediction from conversations),
    refs as (select conv_id || '-' || (turn - 1) as row_id, text as reference from conversations),
    pairs as (select row_id, reference, prediction from refs join predictions using (row_id))"""


def rouge_ctes(n: int) -> str:
    def grams(column: str) -> str:
        return f"""(select row_id, gram, count(*) as c from
            (select row_id, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i:i + {n} - 1], ' '))) as gram
             from (select row_id, regexp_extract_all(lower({column}), '[a-z0-9]+') as t from pairs)) group by all)"""

    return f"""
    pg{n} as {grams('prediction')}, rg{n} as {grams('reference')},
    o{n} as (select row_id, sum(least(p.c, r.c)) as o from pg{n} p join rg{n} r using (row_id, gram) group by row_id),
    pn{n} as (select row_id, sum(c) as c from pg{n} group by row_id),
    rn{n} as (select row_id, sum(c) as c from rg{n} group by row_id),
    rouge{n} as (select row_id, coalesce(2.0 * o / (coalesce(pn{n}.c, 0) + coalesce(rn{n}.c, 0)), 0.0)::double as rouge{n}
        from pairs left join o{n} using (row_id) left join pn{n} using (row_id) left join rn{n} using (row_id))"""


# The level of a match (i, j) is the length of the longest chain of matches that ends there.
LCS = """
    words as materialized (select row_id, regexp_extract_all(lower(reference), '[a-z0-9]+') as a,
                                  regexp_extract_all(lower(prediction), '[a-z0-9]+') as b from pairs),
    aw as (select row_id, unnest(range(len(a))) as i, unnest(a) as t from words),
    bw as (select row_id, unnest(range(len(b))) as j, unnest(b) as t from words),
    levels as (
        select row_id, i, j, 1 as k from aw join bw using (row_id, t)
        union all
        select row_id, i, j, k + 1 from (
            select *, min(j) over (partition by row_id order by i range between unbounded preceding and 1 preceding) as m
            from levels) where m < j),
    lcs as (select row_id, max(k) as o from levels group by row_id),
    "rougeL" as (select row_id, (case when coalesce(o, 0) > 0 then 2.0 * o / (len(a) + len(b)) else 0.0 end)::double as "rougeL"
                 from words left join lcs using (row_id))"""

# The same per pair of lines, with the whole table so that one subsequence can be traced back.
LINE_LCS = """
    la as (select row_id, al, regexp_extract_all(lower(line), '[a-z0-9]+') as a from (
        select row_id, unnest(range(len(l))) as al, unnest(l) as line from (select row_id, string_split(reference, chr(10)) as l from pairs))),
    lb as (select row_id, bl, regexp_extract_all(lower(line), '[a-z0-9]+') as b from (
        select row_id, unnest(range(len(l))) as bl, unnest(l) as line from (select row_id, string_split(prediction, chr(10)) as l from pairs))),
    line_pairs as materialized (select row_id, al, bl, a, b from la join lb using (row_id) where len(a) > 0 and len(b) > 0),
    ai as materialized (select row_id, al, unnest(range(1, len(a) + 1)) as i, unnest(a) as t from la),
    bj as materialized (select row_id, bl, unnest(range(1, len(b) + 1)) as j, unnest(b) as t from lb),
    line_levels as (
        select row_id, al, bl, i, j, 1 as k from ai join bj using (row_id, t)
        union all
        select row_id, al, bl, i, j, k + 1 from (
            select *, min(j) over (partition by row_id, al, bl order by i range between unbounded preceding and 1 preceding) as m
            from line_levels) where m < j),
    grid as (select row_id, al, bl, i, j, ai.t = bj.t as same, coalesce(k, 0) as k from ai join bj using (row_id)
             left join (select row_id, al, bl, i, j, max(k) as k from line_levels group by all) using (row_id, al, bl, i, j)),
    along as (select *, max(k) over (partition by row_id, al, bl, i order by j) as r from grid),
    filled as (select row_id, al, bl, i, j, same, max(r) over (partition by row_id, al, bl, j order by i) as v from along),
    cells as materialized (select row_id, al, bl, i, j, case when same then 'd'
            when coalesce(lag(v) over (partition by row_id, al, bl, i order by j), 0)
               > coalesce(lag(v) over (partition by row_id, al, bl, j order by i), 0) then 'l' else 'u' end as step from filled),
    walk as (
        select row_id, al, bl, len(a) as i, len(b) as j, '' as step, 0 as spot from line_pairs
        union all
        select w.row_id, w.al, w.bl, w.i - (c.step <> 'l')::int, w.j - (c.step <> 'u')::int, c.step, w.i
        from walk w join cells c on w.row_id = c.row_id and w.al = c.al and w.bl = c.bl and w.i = c.i and w.j = c.j),
    covered as (select distinct row_id, al, spot as i from walk where step = 'd'),
    taken as (select row_id, t, count(*) as n from covered join ai using (row_id, al, i) group by all),
    offered as (select row_id, t, count(*) as n from bj group by all),
    hits as (select row_id, sum(least(taken.n, offered.n)) as o from taken join offered using (row_id, t) group by row_id),
    "rougeLsum" as (select row_id, (case when coalesce(o, 0) > 0 then
            2.0 * o / ((select count(*) from ai where ai.row_id = p.row_id) + (select count(*) from bj where bj.row_id = p.row_id))
            else 0.0 end)::double as "rougeLsum" from pairs p left join hits using (row_id))"""

_CHANGED = "replace(replace({t}, ' the ', ' a '), ' le ', ' un ')"
_TEXT = "replace(text, '.', ';')"
SENTENCE_PAIRS = f"""
    texts as (select conv_id || '-' || turn as row_id, {_TEXT} as reference, {_CHANGED.format(t=_TEXT)} as prediction
              from conversations),
    sides as materialized (select row_id, {trimmed("string_split(prediction, ';')")} as p,
        {trimmed("string_split(reference, ';')")} as r from texts)"""
PRF = f"""{SENTENCE_PAIRS},
    hit as (select row_id, len(p) as np, len(r) as nr, len(list_filter(p, lambda s: list_contains(r, s))) as tp from sides),
    ratios as (select row_id, case when np > 0 then tp / np else 0 end as precision,
                      case when nr > 0 then tp / nr else 0 end as recall from hit),
    prf as (select row_id, precision::double as precision, recall::double as recall,
        (case when precision + recall > 0 then 2 * precision * recall / (precision + recall + 1e-8) else 0 end)::double as f1
        from ratios)"""


def _bleu_ctes() -> str:
    out = f"""{PRF},
    ps as (select row_id, unnest(range(len(p))) as i, regexp_extract_all(unnest(p), {q(TOKEN)}) as t from sides),
    rs as (select row_id, unnest(range(len(r))) as j, regexp_extract_all(unnest(r), {q(TOKEN)}) as t from sides)"""
    for side, key in (("ps", "i"), ("rs", "j")):
        out += f""",
    {side}g as (select row_id, {key}, n, gram, count(*) as c from
        (select row_id, {key}, n, unnest(list_transform(range(1, len(t) - n + 2), lambda k: array_to_string(t[k:k + n - 1], ' '))) as gram
         from (select *, unnest([1, 2, 3, 4]) as n from {side})) group by all)"""
    clipped = ", ".join(f"sum(case when n = {n} then least(p.c, r.c) else 0 end) as c{n}" for n in range(1, 5))
    logs = " + ".join(
        f"ln((case when coalesce(c{n}, 0) = 0 then 0.1 else c{n} end) / greatest(1, len(p.t) - {n} + 1))" for n in range(1, 5)
    )
    return out + f""",
    clip as (select row_id, i, j, {clipped} from psg p join rsg r using (row_id, n, gram) group by all),
    scored as (select p.row_id, p.i, case when coalesce(c1, 0) = 0 then 0.0 else
        exp((case when len(p.t) > len(r.t) then 0.0 else 1.0 - len(r.t) / len(p.t) end) + ({logs}) / 4) end as b
        from ps p join rs r using (row_id) left join clip using (row_id, i, j)),
    best as (select row_id, i, max(b) as b from scored group by all),
    bleu as (select row_id, coalesce(avg(b), 0.0)::double as bleu from texts left join best using (row_id) group by row_id)"""


BLEU = _bleu_ctes()

_ORDER = "'aspect: ' || {a} || ', aspect term: ' || o_custkey || ', opinion term: good, sentiment: ' || {s}"
_GUESS = "case when o_totalprice > 300000 then '1-URGENT' else o_orderpriority end"
_MOOD = "case when o_totalprice > 400000 then 'X' when o_totalprice < 50000 then 'O' else o_orderstatus end"
# The labels behind the texts; orders below 10000 have no parsable prediction.
ORDER_PAIRS = f"""
    parsed as (select o_orderpriority as aspect, {_GUESS} as aspect_guess, o_orderstatus as sentiment,
        {_MOOD} as sentiment_guess from orders where o_totalprice >= 10000),
    fields as (select 'aspect' as field, aspect as truth, aspect_guess as guess from parsed union all
               select 'sentiment', sentiment, sentiment_guess from parsed)"""


def metrics(source: str, *columns: str, prefix: str = "") -> str:
    return " union all ".join(
        f"select {q(prefix + c)} as metric, round(avg({c}), 6) as value from {source}" for c in columns
    )


ORACLES: dict[str, str] = {
    "clean_strip_ws": step(strip),
    "clean_collapse_ws": step(collapse),
    "clean_punct_space": step(punct),
    "clean_digit_space": step(digits),
    "clean_sentence_space": step(sentences),
    "clean_capitalise": step(capitalise),
    "clean_symbols": step(symbols),
    "clean_contractions": step(contractions),
    "clean_mojibake": step(mojibake, I.MOJIBAKE),
    "clean_tags": f"select page_id, {tags('html')} as html from pages",
    "clean_entities": f"select page_id, {q(I.ENTITIES_DECODED)} || {entities('html')} as html from pages",
    "clean_text": f"with src as (select doc_id as id, {q(I.NOISE)} || text as t from documents), {clean_ctes('src')} "
                  "select id as doc_id, t as text from s5",
    "clean_reviews": f"with {language_ctes()}, src as (select doc_id as id, text as t from detected where language = 'en'"
                     f" and text <> 'No content'), {clean_ctes('src')} "
                     "select min(id) as row_id, t as review_text from s5 where t <> '' group by t",
    "sentinel_filter": f"select o_orderkey, o_orderpriority from orders where o_orderpriority <> {q(I.ORDER_SENTINEL)}",
    "blank_filter": r"with n as (select doc_id, regexp_replace(text, '[A-Za-z.,\n]+', ' ', 'g') as text from documents) "
                    rf"select * from n where regexp_matches(text, '[^{S_IN}]')",
    "lang_detect": f"with {language_ctes()} select doc_id, language from detected",
    "lang_ngrams": f"with {ngram_ctes()} select lang as language, 'ngram' as kind, place::int as place, count(*) as n from grams "
                   "group by all union all select lang, 'script', place::int, count(*) from letters group by all",
    "lang_identify": f"with {identified_ctes()} select doc_id, split, language, lead from identified",
    "lang_accuracy": f"with {identified_ctes()} select split, count(*) as rows, count(*) filter (where language = lang) as right, "
                     "count(*) filter (where language = 'unknown') as undecided, true as enough from identified group by split",
    "lang_filter": "select doc_id, text from documents where lang = 'en'",
    "dedup_keep_first": "select doc_id, text, lang, source from documents "
                        "qualify row_number() over (partition by text order by doc_id) = 1",
    "extract_review_key": "select id as review_id, nullif(regexp_extract(id, '(REV[0-9]+)', 1), '') as review_key, "
                          "split_part(id, '-', 1) as prefix from (select (case when role = 'user' then 'REV' else 'X' end)"
                          " || conv_id || '-' || turn as id from conversations)",
    "drop_unkeyed": "select 'REV' || conv_id || '-' || turn as review_id, 'REV' || conv_id as review_key "
                    "from conversations where role = 'user'",
    "group_split": f"with {RANKED} select conv_id, turn, review_key, split from keyed join labelled using (review_key)",
    "group_split_hash": f"with keyed as ({KEYED}), b as (select *, ('0x' || substr(md5('42:' || review_key), 1, 8))::bigint"
                        " % 10 as b from keyed) select conv_id, turn, review_key, case when b < 8 then 'train' "
                        "when b = 8 then 'validation' else 'test' end as split from b",
    "split_counts": f"with {RANKED} select split, count(*) as rows from keyed join labelled using (review_key) group by split",
    "distinct_keys": f"with {RANKED} select review_key, split from labelled",
    "split_semi_join": f"with {RANKED} select conv_id, turn, review_key from keyed "
                       "where review_key in (select review_key from labelled where split = 'test')",
    "component_pairs": f"select 'REV' || conv_id as review_key, {q(COMPONENT_PROMPT)} || arg_max(text, turn) as input_text, "
                       "string_agg(text, ' ; ' order by turn) as target_text from conversations group by conv_id",
    "component_pairs_plain": "select 'REV' || conv_id as review_key, arg_max(text, turn) as input_text, string_agg("
                             "case when turn > 0 then text else 'None' end, ' ; ' order by turn) as target_text "
                             "from conversations group by conv_id",
    "absa_pairs": f"select p_partkey, {q(QUAD_PROMPT)} || p_name as input_text, 'aspect: ' || p_type || ', aspect term: ' || "
                  "(case when p_size > 10 then p_name else 'None' end) || ', opinion term: ' || "
                  "(case when p_size > 25 then p_brand else 'None' end) || ', sentiment: ' || "
                  "(case when p_retailprice > 1000 then 'positive' else 'negative' end) as target_text from part",
    "prompts": "with l as (select doc_id, " + strip(r"replace(text, chr(10), ' ')") + " as line, " + strip("text")
               + f" as text from documents) select doc_id, {q(COMPONENT_PROMPT)} || line as component_t5, "
               f"line as component_bart, {q(QUAD_PROMPT)} || text as quad_t5 from l",
    "vocabulary_build": f"with {VOCABULARY} select token, n, token_id from vocabulary",
    "token_encode": f"with {VOCABULARY} select doc_id, {text_of('ids')} as ids from {encoded('text')}",
    "token_encode_join": f"with {VOCABULARY} select doc_id, {text_of('ids')} as ids from {encoded('text')}",
    "token_pad_mask": f"""with {VOCABULARY}, i as {encoded('text', 64)}, o as {encoded('source', 8)}
        select doc_id, {text_of("list_concat(i.ids, list_transform(range(64 - len(i.ids)), lambda k: 0))")} as input_ids,
        {text_of("list_concat(list_transform(i.ids, lambda k: 1), list_transform(range(64 - len(i.ids)), lambda k: 0))")}
            as attention_mask,
        {text_of("list_concat(o.ids, list_transform(range(8 - len(o.ids)), lambda k: -100))")} as labels
        from i join o using (doc_id)""",
    "subword_round_trip": "select doc_id, text from documents",
    "label_mask": "with g as (select doc_id, list_transform(string_split(text, ' '), lambda w: length(w))[1:512] as ids "
                  "from documents) select doc_id, "
                  + text_of("list_concat(list_transform(ids, lambda i: case when i = 0 then -100 else i end), "
                            "list_transform(range(512 - len(ids)), lambda k: -100))") + " as labels from g",
    "parse_lenient": parser((",", ",", ",", None)),
    "parse_safe": parser((", aspect term:", ", opinion term:", ", sentiment:", None)),
    "parse_strict": f"with {QUAD_TEXT} select p_partkey, "
                    + ", ".join(f"case when {STRICT_OK} then {strip(f'regexp_extract(s, {q(p)}, 1)')} end as {f}" for f, p in _STRICT)
                    + " from quad_texts",
    "serialise_quads": "select p_partkey, 'aspect: ' || p_type || ', aspect term: ' || "
                       "(case when p_size > 10 then p_name else 'None' end) || ', opinion term: ' || "
                       "(case when p_size > 25 then p_brand else 'None' end) || ', sentiment: ' || "
                       "(case when p_retailprice > 1000 then 'positive' else 'negative' end) as quad_text from part",
    "strip_wrappers": "select doc_id, trim(trim(string_split('[''' || text || ''']', chr(10))[1], '[]'), '''\"') as piece from documents",
    "split_components": f"select doc_id, len(c)::int as n, array_to_string(c, ' ; ') as components from (select doc_id, {MARKED} as c from documents)",
    "explode_components": f"select doc_id, pos, component from {exploded(MARKED)}",
    "quad_lines": f"""with w as (select doc_id, lang, source, {strip("replace(text, '#', ' ')")} as sentence,
            regexp_extract_all(lower(text), '[a-z]+') as w from documents),
        placed as (select *, unnest(case when len(w) = 0 then [null] else range((len(w) + 1) // 2) end) as k from w)
        select doc_id, md5(sentence) as sentence, k::int as pos, w[2 * k + 1] as term,
               case when k is not null then source end as aspect,
               case when k is null then null when lang <> 'en' then 'neutral' when k % 2 = 0 then 'positive' else 'negative' end as sentiment,
               case when k is not null then coalesce(w[2 * k + 2], 'NULL') end as opinion, false as bad from placed""",
    "quad_lines_broken": f"""select doc_id, case when lang in ('de', 'es') then 0
            else (len(regexp_extract_all(lower(text), '[a-z]+')) + 1) // 2 end as quads, lang in ('de', 'es') as bad,
            length({strip("replace(text, '#', ' ')")})::int as chars from documents""",
    "column_check": "select doc_id, 'missing column(s): review; found: doc_id, text, lang, source' as message from documents",
    "lexicon_train_partial": f"with {LABELLED_PARTIAL} select kind, phrase, label, support from lexicon",
    "lexicon_long_phrases": f"""with p as (select p_partkey, p_brand, array_to_string(regexp_extract_all(lower(
            p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name || ' ' || p_type), {q(WORDS)}), ' ') as phrase from part),
        best as (select phrase, min(p_brand) as aspect from p group by phrase)
        select p_partkey, method, aspect, phrase as aspect_term, 'NULL' as opinion_term, 'neutral' as sentiment
        from p join best using (phrase), (values ('in_row'), ('join')) as m(method)""",
    "eval_checked_pairs": "select conv_id || '-' || turn as row_id, text as reference, 'so: ' || text as prediction from conversations",
    "classifier_predict": "select count(*) as rows, true as at_least_majority, true as labels_known from documents join labels using (doc_id) "
                          "where ('0x' || substr(md5('42:REV' || doc_id), 1, 8))::bigint % 10 = 9",
    "rouge_bootstrap": f"""with {TURNS}, {rouge_ctes(1)},
        u as (select row_id, rouge1, sample, ('0x' || substr(md5(row_id || '|' || sample || '|42'), 1, 12))::bigint / pow(2, 48) as u
              from rouge1, range(1, 201) as r(sample)),
        cumulative(bound) as (values {", ".join(f"({b!r})" for b in POISSON)}),
        drawn as (select sample, rouge1, (select count(*) from cumulative where u >= bound) as w from u),
        means as (select sample, sum(rouge1 * w) / nullif(sum(w), 0) as m from drawn group by sample)
        select 'rouge1' as metric, round(quantile_cont(m, 0.5), 6) as value from means""",
    "segment_components": f"select doc_id, pos, component from {exploded(SEGMENTS)}",
    "lexicon_train": f"with {LEXICON} select kind, phrase, label, support from lexicon",
    "lexicon_predict": f"with {PREDICTED} select doc_id, pos, aspect, aspect_term, opinion_term, sentiment from predicted",
    "lexicon_predict_join": f"with {PREDICTED} select doc_id, pos, aspect, aspect_term, opinion_term, sentiment from predicted",
    "review_opinions": f"with {PREDICTED} select doc_id as review_id, pos, text as full_review, component, aspect, aspect_term, "
                       "opinion_term, sentiment from predicted join documents using (doc_id)",
    "batch_predict": "with c as (select doc_id, "
                     + trimmed("string_split(replace(replace(text, chr(10), ' '), '.', ';'), ';')")
                     + " as c from documents) select doc_id, len(c)::int as n, array_to_string(c, ' ; ') as components from c",
    "batch_predict_quads": "select p_partkey, 'aspect: Movie, aspect term: ' || p_name || ', opinion term: None, "
                           "sentiment: neutral' as prediction, trim(p_name) as aspect_term from part",
    "eval_pairs_join": f"with {TURNS} select row_id, reference, prediction from pairs",
    "eval_unmatched": f"""with {TURNS}, s as (select row_id, 1 as p, 0 as r from predictions union all select row_id, 0, 1 from refs)
        select row_id, sum(p)::bigint as n_predictions, sum(r)::bigint as n_references from s group by row_id
        having sum(p) <> 1 or sum(r) <> 1""",
    "sentence_prf": f"with {PRF} select row_id, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from prf",
    "sentence_bleu": f"with {BLEU} select row_id, round(bleu, 6) as bleu from bleu",
    "sentence_mean": f"with {BLEU}, everything as (select * from prf join bleu using (row_id)) "
                     + metrics("everything", "precision", "recall", "f1", "bleu").replace("select '", "select 'mean_"),
    "rouge1": f"with {TURNS}, {rouge_ctes(1)} select row_id, round(rouge1, 6) as rouge1 from rouge1",
    "rouge2": f"with {TURNS}, {rouge_ctes(2)} select row_id, round(rouge2, 6) as rouge2 from rouge2",
    "rouge_mean": f"with {TURNS}, {rouge_ctes(1)}, {rouge_ctes(2)} {metrics('rouge1', 'rouge1')} union all {metrics('rouge2', 'rouge2')}",
    "rouge_l": f'with recursive {TURNS}, {LCS} select row_id, round("rougeL", 6) as "rougeL" from "rougeL"',
    "rouge_lsum": f'with recursive {TURNS}, {LINE_LCS} select row_id, round("rougeLsum", 6) as "rougeLsum" from "rougeLsum"',
    "rouge_all": f"with recursive {TURNS}, {rouge_ctes(1)}, {rouge_ctes(2)}, {LCS}, {LINE_LCS} "
                 + " union all ".join(metrics(f'"{m}"', m).replace(f"avg({m})", f'avg("{m}")')
                                      for m in ("rouge1", "rouge2", "rougeL", "rougeLsum")),
    "set_prf": f"""with {SENTENCE_PAIRS},
        ps as (select distinct lower(unnest(p)) as s from sides), rs as (select distinct lower(unnest(r)) as s from sides),
        n as (select (select count(*) from ps) as np, (select count(*) from rs) as nr,
                     (select count(*) from (select s from ps intersect select s from rs)) as tp),
        v as (select tp / (np + 1e-8) as precision, tp / (nr + 1e-8) as recall from n),
        f as (select precision, recall, 2 * precision * recall / (precision + recall + 1e-8) as f1 from v)
        {metrics('f', 'precision', 'recall', 'f1')}""",
    "exact_match": f"with {SENTENCE_PAIRS}, e as (select ({strip('reference')} = {strip('prediction')})::int as exact_match from texts) "
                   + metrics("e", "exact_match"),
    "micro_f1": f"with {ORDER_PAIRS}, m as (select (aspect = aspect_guess)::int as aspect_f1, 1 as aspect_term_f1, 1 as opinion_term_f1, "
                "(sentiment = sentiment_guess)::int as sentiment_f1 from parsed) "
                + metrics("m", "aspect_f1", "aspect_term_f1", "opinion_term_f1", "sentiment_f1"),
    "class_report": f"""with {ORDER_PAIRS},
        names as (select field, truth as label from fields union select field, guess from fields),
        counts as (select n.field, n.label, (select count(*) from fields f where f.field = n.field and f.truth = n.label) as support,
            (select count(*) from fields f where f.field = n.field and f.guess = n.label) as guessed,
            (select count(*) from fields f where f.field = n.field and f.truth = n.label and f.guess = n.label) as hits from names n),
        per as (select field, label, case when guessed > 0 then hits / guessed else 0.0 end as p,
            case when support > 0 then hits / support else 0.0 end as r, support, hits from counts),
        pf as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end as f from per),
        report as (
            select field, label, p, r, f, support from pf union all
            select field, 'accuracy', null, null, sum(hits) / sum(support), sum(support) from pf group by field union all
            select field, 'macro avg', avg(p), avg(r), avg(f), sum(support) from pf group by field union all
            select field, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                   sum(f * support) / sum(support), sum(support) from pf group by field)
        select field, label, round(p::double, 6) as precision, round(r::double, 6) as recall, round(f::double, 6) as f1,
               support::bigint as support from report""",
    "confusion": f"with {ORDER_PAIRS} select field, truth, guess, count(*) as n from fields group by all",
    "dropped_pairs": "select count(*) as pairs, count(*) filter (o_totalprice >= 10000) as scored, "
                     "count(*) filter (o_totalprice < 10000) as dropped from orders",
    "io_raw_reviews": "select doc_id as row_id, text as review_text from documents",
    "io_annotated": "select 'REV' || p_partkey as \"Review ID\", p_name as \"Full review\", p_name as \"Component sentence\", "
                    "p_type as \"Aspect Category\", case when p_size > 10 then p_name end as \"Aspect Terms\", "
                    "case when p_size > 25 then p_brand end as \"Opinion Terms\", "
                    "case when p_retailprice > 1000 then 'positive' else 'negative' end as \"Polarity Sentiment\" from part",
    "io_reviews": "select 'REV' || doc_id as review_id, case when doc_id % 100 <> 0 then text else '' end as review from documents",
    "io_splits": f"with {RANKED} select conv_id, turn, text, split from keyed join labelled using (review_key)",
    "io_token_cache": f"with {VOCABULARY} select doc_id, {text_of('ids')} as ids from {encoded('text')}",
    "io_predictions": f"with {QUAD_TEXT} select p_partkey as row_id, s as input, s as reference, 'a \"quoted\", text' as prediction from quad_texts",
}
ORACLES["io_lexicon"] = ORACLES["lexicon_train"]
ORACLES["review_opinions_join"] = ORACLES["review_opinions"]
ORACLES["review_opinions_backend"] = f"""
    with pieces as (select doc_id, {trimmed("string_split(replace(replace(text, chr(10), ' '), '.', ';'), ';')")} as parts from documents),
    rows as {exploded("parts", "pieces")}
    select doc_id as review_id, pos, text as full_review, component, 'Movie' as aspect,
           {strip("split_part(component, ',', 1)")} as aspect_term, 'None' as opinion_term, 'neutral' as sentiment
    from rows join documents using (doc_id)"""
ORACLES["io_opinions"] = ORACLES["review_opinions"]
ORACLES["io_metrics"] = ORACLES["micro_f1"]
