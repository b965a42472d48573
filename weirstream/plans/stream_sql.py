"""DuckDB SQL of the stream features, detectors and verdicts, to compare the Spark operators with."""

from __future__ import annotations

from weirstream.functions.text import ARTEFACTS, DIGITS, EXPECTED, LETTERS, RUN_EXCLUDED, SCRIPTS, SPACES, SYMBOLS, WORD, foreign
from weirstream.operators import detectors, synth
from weirstream.operators.factuality import OPENERS
from weirstream.operators.sequence_features import ALPHA, BASELINE, FINGERPRINT_WORDS, LEAST_ALPHABET, LEAST_WORDS, LONGEST_RUN, MOST_SHINGLES, RECENT, SHINGLE, SMOOTHING, STRIDE, WEIGHTS
from weirstream.operators.streams import CHUNK, EVERY, HOLD

Q = "'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def count(pattern: str, text: str = "w") -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))::bigint"


STREAMS = "s as materialized (select doc_id as stream_id, text, length(text) as n_chars from documents)"
def points_of(chunk: int, hold: int = HOLD, every: int = EVERY) -> str:
    """Checkpoints of texts that come in chunks: the first chunk end that reaches hold, each one that is every further on, and an
    end that is due. A chunk longer than any text leaves the end."""
    first, step = chunk * -(-hold // chunk), chunk * -(-every // chunk)
    return f"""p as materialized (select stream_id, text, n_chars, pos, row_number() over (partition by stream_id order by pos) as k from (
  select * exclude (regular), unnest(case when n_chars >= coalesce(regular[-1] + {every}, {hold}) and coalesce(regular[-1] < n_chars, true) then list_append(regular, n_chars) else regular end) as pos
  from (select *, range({first}, n_chars + 1, {step}) as regular from s)))"""


POINTS = points_of(CHUNK)
#: Those and the end of every text (k null); positions once.
ENDS = "pe as materialized (select stream_id, text, n_chars, pos, k from p union all select stream_id, text, n_chars, n_chars, null from s where n_chars > 0)"
AT = "a as materialized (select stream_id, pos, min(k) as k, any_value(text) as text, any_value(n_chars) as n_chars from pe group by stream_id, pos)"
CLASS = "case when regexp_matches(ch, '[{}]') then 'digit' when regexp_matches(ch, '[{}]') then 'space' when regexp_matches(ch, {}) then 'symbol' {} else 'other' end".format(
    DIGITS, SPACES, quoted(f"[{SYMBOLS}]"), " ".join(f"when regexp_matches(ch, '[{r}]') then '{n}'" for n, r in SCRIPTS.items())
)
CHARS = f"c as materialized (select stream_id, i, ch, {CLASS} as cls from (select stream_id, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) as i from s where n_chars > 0))"


def windowed(points: str = "a") -> str:
    """CTEs wf: window features of the points."""
    return f"""wc as (select stream_id, k, pos, n_chars, w, greatest(length(w), 1) as n, {count(f"[{DIGITS}]")} as digits, {count(f"[{SPACES}]")} as spaces, {count(f"[{SYMBOLS}]")} as symbols,
  {count(f"[{LETTERS}]")} as letters, {count(f"[{foreign(EXPECTED)}]")} as alien, {' + '.join(count(p) for p in ARTEFACTS)} as artefacts, regexp_extract_all(w, '{WORD}') as words
  from (select *, substr(text, greatest(pos - 600, 0) + 1, least(pos, 600)) as w from {points})),
wf as materialized (select stream_id, k, pos, n_chars, digits / n as digit_frac, case when letters > 0 then alien / letters else 0.0 end as foreign_frac,
  case when len(words) > 0 then len(list_distinct(words)) / len(words) else 1.0 end as ttr, artefacts / greatest(1.0, n / 100) as structural_density, symbols / n as symbol_frac, spaces / n as space_frac from wc)"""


ENTROPY = """ew as (select stream_id, pos, ch, count(*) as c from (select stream_id, pos, unnest(string_split(substr(text, greatest(pos - 600, 0) + 1, least(pos, 600)), '')) as ch from a) group by all),
es as (select stream_id, pos, sum(c) as n, sum(c * log2(c)) as s from ew group by all),
ef as (select stream_id, ch, min(i) as i from c group by all),
en as materialized (select es.stream_id, es.pos, case when n < 2 then 1.0 else (log2(n) - s / n) / log2(greatest(alphabet, 2)) end as entropy from es join
  (select a.stream_id, a.pos, count(*) as alphabet from a join ef on ef.stream_id = a.stream_id and ef.i <= a.pos group by all) x using (stream_id, pos))"""
SWITCHES = """sw as (select *, (letter and prev <> cls)::bigint as switched from (select *, last_value(case when letter then cls end ignore nulls) over
  (partition by stream_id order by i rows between unbounded preceding and 1 preceding) as prev from (select *, cls in ({}) as letter from c))),
sc as materialized (select stream_id, i, ch, cls, coalesce(sum(switched) over (partition by stream_id order by i), 0) as switches from sw)""".format(", ".join(f"'{n}'" for n in SCRIPTS))
RUNS = """rb as (select stream_id, i, ch, coalesce(ch <> lag(ch) over (partition by stream_id order by i), true) or ch in ({}) as breaks from c),
rr as (select *, sum(breaks::bigint) over (partition by stream_id order by i) as run from rb),
rl as (select *, row_number() over (partition by stream_id, run order by i) as len from rr),
ru as materialized (select stream_id, i, max(len) over (partition by stream_id order by i) as longest_run from rl)""".format(", ".join("chr(10)" if x == "\n" else "chr(9)" if x == "\t" else quoted(x) for x in RUN_EXCLUDED))


def _context(k: int) -> str:
    whole = " || ".join(f"l{j}" for j in range(k, 0, -1))
    short = " || ".join(f"case when i - 1 >= {j} and {k} - (i - 1) >= {j} then l{j} else '' end" for j in range(k, 0, -1))
    return f"case when i - 1 >= {k} then {whole} else {short} end"


_orders = range(len(WEIGHTS) - 1, -1, -1)
SURPRISE = f"""l as (select stream_id, i, ch, {', '.join(f"lag(ch, {j}) over (partition by stream_id order by i) as l{j}" for j in range(1, len(WEIGHTS)))}, (row_number() over (partition by stream_id, ch order by i) = 1)::bigint as fresh from c),
lx as (select stream_id, i, ch, greatest({LEAST_ALPHABET}, coalesce(sum(fresh) over (partition by stream_id order by i rows between unbounded preceding and 1 preceding), 0) + 1) as v, '' as c0, {', '.join(f"{_context(k)} as c{k}" for k in range(1, len(WEIGHTS)))} from l),
ln as (select stream_id, i, v, {', '.join(f"row_number() over (partition by stream_id, c{k} order by i) - 1 as t{k}, row_number() over (partition by stream_id, c{k}, ch order by i) - 1 as n{k}" for k in _orders)} from lx),
su as materialized (select stream_id, i, -log2(least(1.0, greatest(1e-9, {' + '.join(f"{w} * (n{k} + {SMOOTHING}) / (t{k} + {SMOOTHING} * v)" for k, w in zip(_orders, WEIGHTS, strict=True))}))) as surprise from ln)"""
BASE = f"""bl as (select stream_id, count(*) as n, list_reduce(list({{'mean': surprise::double, 'mad': 0.0::double}} order by i), lambda a, x: {{'mean': a.mean + {ALPHA}::double * (x.mean - a.mean), 'mad': a.mad + {ALPHA}::double * (abs(x.mean - a.mean) - a.mad)}}) as b
  from su where i <= {BASELINE} group by stream_id),
ba as materialized (select stream_id, n, b.mean as mean, b.mad as mad from bl)"""
RECENTLY = f"""rs as (select stream_id, i, n, mean, mad, avg(surprise) over w as now, avg((surprise < greatest(0.5, mean - mad))::int) over w as low from su join ba using (stream_id)
  window w as (partition by stream_id order by i rows between {RECENT - 1} preceding and current row)),
sz as materialized (select a.stream_id, a.pos, case when n < 3 then 0.0 else (now - mean) / (1.4826 * mad + 1e-6) end as surprise_z, low as surprise_low_frac from a join rs on rs.stream_id = a.stream_id and rs.i = a.pos)"""
SHINGLES = f"""sh as (select stream_id, i, row_number() over (partition by stream_id, shingle order by i) as nth from (select stream_id, i, substr(text, i - {SHINGLE - 1}, {SHINGLE}) as shingle from (select *, unnest(range({SHINGLE}, n_chars + 1, {STRIDE})) as i from s))),
sr as (select stream_id, i, row_number() over w as total, sum((nth > 1)::bigint) over w as repeats, max(nth) over w as most from sh window w as (partition by stream_id order by i)),
re as materialized (select a.stream_id, a.pos, coalesce(repeats / total, 0.0) as repeat_rate, least(coalesce(most, 0), {MOST_SHINGLES}) / {MOST_SHINGLES} as max_shingle_count
  from a left join sr on sr.stream_id = a.stream_id and sr.i = case when a.pos >= {SHINGLE} then {SHINGLE} + {STRIDE} * ((a.pos - {SHINGLE}) // {STRIDE}) end)"""
_bits = "translate(substr(md5(word), 1, 16), '0123456789abcdef', 'ghijklmnopqrstuv')"
for _d, _c in enumerate("ghijklmnopqrstuv"):
    _bits = f"replace({_bits}, '{_c}', '{_d:04b}')"
DRIFT = f"""wg as (select *, cls in ('space', 'symbol') as sep, sum((cls in ('space', 'symbol'))::bigint) over (partition by stream_id order by i) - (cls in ('space', 'symbol'))::bigint as g from c),
ww as (select stream_id, g, max(case when sep then i end) as i, lower(string_agg(case when not sep and regexp_matches(ch, '[\\p{{L}}\\p{{N}}]') then ch end, '' order by i)) as word from wg group by stream_id, g),
wb as materialized (select stream_id, i, row_number() over (partition by stream_id order by i) as w, {_bits} as bits from ww where i is not null and word <> ''),
wn as (select a.stream_id, a.pos, bits from a join wb on wb.stream_id = a.stream_id and wb.i <= a.pos qualify row_number() over (partition by a.stream_id, a.pos order by w desc) <= {FINGERPRINT_WORDS}),
fp as (select stream_id, pos, count(*) as n_words, {' || '.join(f"case when 2 * sum(substr(bits, {b + 1}, 1)::int) > count(*) then '1' else '0' end" for b in range(64))} as f from wn group by all),
fo as (select a.stream_id, a.pos, a.k, n_words, f, first_value(f) over o as f0, first_value(n_words) over o as n0, first_value(k) over o as k0, row_number() over o as r from a left join fp using (stream_id, pos) window o as (partition by stream_id order by pos)),
dr as materialized (select stream_id, pos, case when n0 >= {LEAST_WORDS} and k0 = 1 and n_words >= {LEAST_WORDS} and r > 1 then hamming(f, f0) / 64 else 0.0 end as simhash_drift from fo)"""
FEATURES = f"""f as materialized (select pe.stream_id, pe.k, pe.pos, pe.n_chars, digit_frac, foreign_frac, repeat_rate, 1.0 as zlib_ratio, ttr, switches / pe.pos * 100 as script_switch_rate, structural_density, symbol_frac,
  least(longest_run, {LONGEST_RUN}) / {LONGEST_RUN} as max_char_run, space_frac, surprise_z, surprise_low_frac, simhash_drift, entropy, max_shingle_count
  from pe join wf using (stream_id, pos) join sc on sc.stream_id = pe.stream_id and sc.i = pe.pos join ru on ru.stream_id = pe.stream_id and ru.i = pe.pos
  join sz on sz.stream_id = pe.stream_id and sz.pos = pe.pos join re on re.stream_id = pe.stream_id and re.pos = pe.pos join dr on dr.stream_id = pe.stream_id and dr.pos = pe.pos join en on en.stream_id = pe.stream_id and en.pos = pe.pos)"""
ALL_FEATURES = ",\n".join([STREAMS, POINTS, ENDS, AT, CHARS, windowed(), ENTROPY, SWITCHES, RUNS, SURPRISE, BASE, RECENTLY, SHINGLES, DRIFT, FEATURES])


def ramp(x: str, low: float, high: float) -> str:
    return f"least(1.0, greatest(0.0, ({x} - {low}) / ({high} - {low})))"


SCORES = f"""r as (select *, greatest(case when digit_frac > 0.28 then 0.7 + 0.3 * least(1.0, (digit_frac - 0.28) / 0.2) else 0 end, case when foreign_frac > 0.05 then 0.7 + 0.3 * least(1.0, (foreign_frac - 0.05) / 0.25) else 0 end,
  case when repeat_rate > 0.55 and zlib_ratio < 0.32 then 0.85 when repeat_rate > 0.72 then 0.75 else 0 end, case when max_char_run >= 0.5 then 0.7 else 0 end, case when structural_density > 1.2 then 0.75 else 0 end,
  case when ttr < 0.22 and repeat_rate > 0.45 then 0.7 else 0 end) as strong,
  (digit_frac > 0.10)::int + (foreign_frac > 0.02)::int + (repeat_rate > 0.5)::int + (structural_density > 0.6)::int + (symbol_frac > 0.18)::int as signs from f),
d as materialized (select stream_id, k, pos, n_chars, case when signs >= 3 and strong < 0.6 then 0.6 else strong end as rules,
  greatest({ramp('surprise_z', 3.0, 9.0)}, case when repeat_rate > 0.4 then {ramp('surprise_low_frac', 0.85, 0.97)} else 0 end) as ngram,
  least(1.0, {ramp('repeat_rate', 0.55, 0.9)} + case when repeat_rate > 0.5 then 0.3 * {ramp('max_shingle_count', 0.3, 0.8)} else 0 end) as sketch,
  0.60 * {ramp('simhash_drift', 0.42, 0.52)} as simhash, case when entropy < 0.45 and (digit_frac > 0.25 or repeat_rate > 0.5) then {ramp('(0.45 - entropy)', 0.0, 0.25)} * 0.9 + 0.1 else 0 end as entropy from r),
fu as materialized (select *, case when (rules >= 0.5)::int + (ngram >= 0.5)::int + (sketch >= 0.5)::int + (simhash >= 0.5)::int + (entropy >= 0.5)::int >= 2 then least(1.0, greatest(rules, ngram, sketch, simhash, entropy) + 0.12)
  else greatest(rules, ngram, sketch, simhash, entropy) end as p, rules >= 0.85 as hard from d)"""
def reasons_of() -> str:
    """What each score says, without its numbers, with its classes and the strongest detector; ``r`` and ``d`` as above."""
    weak = "(signs >= 3 and strong < 0.6)"
    poor, repeats = "(ttr < 0.22 and repeat_rate > 0.45)", "(repeat_rate > 0.72 and not (repeat_rate > 0.55 and zlib_ratio < 0.32))"
    spike, collapse = f"({ramp('surprise_z', 3.0, 9.0)} >= 0.5)", f"(repeat_rate > 0.4 and {ramp('surprise_low_frac', 0.85, 0.97)} >= 0.5)"
    on = "(entropy < 0.45 and (digit_frac > 0.25 or repeat_rate > 0.5))"
    loop, drift, news, broken, sense = (quoted(c) for c in (detectors.REPETITION, detectors.DRIFT, detectors.REGURGITATION, detectors.STRUCTURAL, detectors.SEMANTIC))
    told = [
        ("rules", "digit_frac > 0.28", "numeric dump digit_frac=#", [broken]), ("rules", "foreign_frac > 0.05", "foreign-script frac=#", [drift]), ("rules", repeats, "repetition rate=#", [loop]),
        ("rules", "max_char_run >= 0.5", "long same-char run", [broken]), ("rules", "structural_density > 1.2", "structural artifacts density=#", [broken, news]),
        ("rules", poor, "vocabulary collapse ttr=#", [loop]), ("rules", weak, "multiple weak anomalies", []),
        ("ngram", spike, "surprise spike z=#", [drift, news]), ("ngram", collapse, "surprise collapse low_frac=#", [loop]),
        ("sketch", "true", "repetition rate=# maxcount=#", [loop]), ("simhash", "true", "semantic drift hamming=#", [news, sense]), ("ent", on, "entropy collapse H=#", [loop, broken]),
    ]
    reasons = ", ".join(f"case when {d} >= 0.5 and {on_} then {quoted(text)} end" for d, on_, text, _ in told)
    classes = ", ".join(f"case when {d} >= 0.5 and {on_} then {c} end" for d, on_, _, own in told for c in own)
    top = " ".join(f"when {d} = best then {quoted(name)}" for d, name in (("rules", "rules"), ("ngram", "ngram"), ("sketch", "sketch"), ("simhash", "simhash"), ("ent", "entropy")))
    return f"""rz as (select r.*, d.rules, d.ngram, d.sketch, d.simhash, d.entropy as ent, greatest(d.rules, d.ngram, d.sketch, d.simhash, d.entropy) as best from r join d on d.stream_id = r.stream_id and d.pos = r.pos and d.k is not distinct from r.k),
rt as (select stream_id, k, pos, array_to_string(list_filter([{reasons}], lambda x: x is not null), '; ') as reasons,
  array_to_string(list_sort(list_distinct(list_filter([{classes}], lambda x: x is not null))), ',') as classes, case when best <= 0 then '' {top} end as top from rz)"""


HINKLEY = """h1 as (select *, p - avg(p) over (partition by stream_id order by k) - 0.02 as x, row_number() over (partition by stream_id order by k) as n from fu where k is not null),
h2 as (select *, sum(x) over (partition by stream_id order by k) as cum from h1),
h3 as (select *, cum - least(0.0, min(cum) over (partition by stream_id order by k)) as ph from h2),
h4 as (select *, ph > 0.35 and n > 3 and sum((ph > 0.35 and n > 3)::int) over (partition by stream_id order by k) = 1 as alarm from h3)"""
STATES = """t1 as (select *, hard or (p >= 0.7 and (k = 1 or coalesce(lag(p >= 0.7) over (partition by stream_id order by k), false))) as corrupt from h4),
t2 as (select *, coalesce(max(corrupt::int) over (partition by stream_id order by k rows between unbounded preceding and 1 preceding), 0) as before, first_value(case when alarm then pos end ignore nulls) over (partition by stream_id order by k) as alarm_pos from t1),
st as materialized (select *, case when corrupt then 'corrupt' when p >= 0.5 then 'suspect' else 'clean' end as state, case when corrupt then coalesce(alarm_pos, pos) end as onset from t2 where before = 0)"""
def verdicts_of(chunk: int) -> str:
    return VERDICT_ROWS.replace("{{chunk}}", str(chunk))


VERDICT_ROWS = """la as (select stream_id, arg_max(state, k) as state, arg_max(p, k) as p, arg_max(onset, k) as onset, arg_max(pos, k) as pos, max(k) as checkpoints, min(case when alarm then pos end) as alarm_at from st group by stream_id),
v as (select e.stream_id, e.n_chars, coalesce(la.state = 'corrupt', false) as aborted, e.p as fp, la.p as cp, la.onset as conset, la.pos as cpos, checkpoints, alarm_at,
  case when la.state = 'corrupt' then 'corrupt' when e.p >= 0.7 then 'corrupt' when e.p >= 0.5 then 'suspect' else 'clean' end as state from (select * from fu where k is null) e left join la using (stream_id)),
vd as materialized (select stream_id, n_chars, state, case when aborted then cp else fp end as p, (case when aborted then conset when state = 'corrupt' then coalesce(alarm_at, cpos) end)::bigint as onset, coalesce(checkpoints, 0)::bigint as checkpoints,
  (case when aborted then cpos else n_chars end)::bigint as read_chars, (case when aborted and checkpoints = 1 then 0 when aborted then (cpos - 1) // {{chunk}} * {{chunk}} when checkpoints is null and fp >= 0.7 then 0 else n_chars end)::bigint as released_chars, aborted from v)"""
VERDICTS = verdicts_of(CHUNK)

#: Events: chunks of 40 characters with the last checkpoint that each has reached, up to the corrupt one.
EVENTS = """ec as (select stream_id, text, n_chars, unnest(range(1, (n_chars + 39) // 40 + 1)) as seq from s where n_chars > 0),
ex as (select *, least(seq * 40, n_chars) as chars from ec),
ek as (select ex.*, st.k, st.pos, st.p as cp, st.state as cs, st.onset as co from ex asof left join st on ex.stream_id = st.stream_id and ex.chars >= st.pos),
eo as (select *, coalesce(chars = pos, false) as here, case when k is null or cs = 'corrupt' then '' when chars = pos and k = 1 then substr(text, 1, chars) else substr(text, (seq - 1) * 40 + 1, 40) end as released from ek where k is null or cs <> 'corrupt' or chars = pos),
ev as materialized (select stream_id, k, pos, seq, chars, case when here then round(cp, 6) else 0.0 end as p, coalesce(cs, 'clean') as state, released, case when here then co end as onset, here and cp > 0 as hot from eo where released <> '' or (here and cp > 0) or seq = 1)"""


def listed(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


CAPITAL = r"^[^\p{L}\p{N}_]*[A-ZÀ-Þ][a-zà-þ]{2,}\n?$"
BARE = "lower(regexp_replace({}, '[^A-Za-zÀ-þ]', '', 'g'))"
NUMERIC = r"^[^\p{L}\p{N}_]*-?\p{Nd}"
UNIT = r"%|pp([^\p{L}\p{N}_]|$)|bp([^\p{L}\p{N}_]|$)|\$|€|₼|percent|faiz"


def kind(opens: str) -> str:
    named = f"regexp_matches(token, {quoted(CAPITAL)}) and not list_contains({listed(OPENERS)}, {BARE.format('token')}) and not {opens}"
    return rf"case when trim(regexp_replace(token, '\s', ' ', 'g')) = '' then '' when regexp_matches(token, {quoted(NUMERIC)}) or regexp_matches(token, {quoted(UNIT)}) then 'number' when {named} then 'entity' else '' end"


def rivals(stop: bool) -> str:
    """Distinct numbers and entities among the likely alternatives ``near``."""
    more = f" and not list_contains({listed(OPENERS)}, {BARE.format('a')})" if stop else ""
    return (
        "len(list_distinct(list_filter(list_transform(near, lambda a: replace(regexp_extract(a, '-?[0-9]+(?:[.,][0-9]+)?', 0), ',', '.')), lambda n: n <> '')))::bigint as numbers, "
        + f"len(list_distinct(list_transform(list_filter(near, lambda a: regexp_matches(a, {quoted(CAPITAL)}){more}), lambda a: {BARE.format('a')})))::bigint as entities"
    )


#: Tokens with entropy, margin and their likely alternatives.
KINDS = rf"""solid as (select *, trim(regexp_replace(token, '\s', ' ', 'g')) as solid from te),
ends as (select *, case when solid <> '' then right(solid, 1) in ('.', '!', '?', ':') or ends_with(token, chr(10)) end as ends from solid),
ki as materialized (select answer_id, pos, token, lp, ps, coalesce(last_value(ends ignore nulls) over (partition by answer_id order by pos rows between unbounded preceding and 1 preceding), true) as opens,
  -list_sum(list_transform(ps, lambda p: p / z * ln(p / z + 1e-12))) as entropy, sl[1] - sl[2] as margin,
  list_transform(list_filter([{{'t': token, 'p': ps[1]}}, {{'t': '7' || token, 'p': ps[2]}}, {{'t': reverse(token), 'p': ps[3]}}], lambda x: x.p >= 0.03), lambda x: x.t) as near from ends)"""
FACT_SIGNALS = f"""sg as (select *, {kind('opens')} as kind, {rivals(True)} from ki),
fl as (select *, coalesce(case when kind = 'number' then numbers >= 2 when kind = 'entity' then entities >= 2 end, false) and (entropy >= 1.2 or margin <= 0.6) as flagged from sg),
rs as (select *, case when flagged then least(1.0, greatest(0.0, least(entropy / 2.4, 1.0), case when margin < 0.6 then least(0.6 / (margin + 1e-6) - 1, 1.0) else 0.0 end)) else 0.0 end::double as risk from fl)"""
FACT_EWMA = """, fa as (select answer_id, list_reduce(list(risk order by pos), lambda s, x: 0.7::double * s + 0.3::double * x, 0.0::double) as moving, max(risk) as peak, count(*) as facts, sum(flagged::int) as flags from rs where kind <> '' group by answer_id)
select a.answer_id, coalesce(round(moving, 3), 0) as fact_uncertainty, coalesce(round(peak, 3), 0) as peak_fact_risk, coalesce(facts, 0)::bigint as fact_tokens, coalesce(flags, 0)::bigint as flagged_fact_tokens, coalesce(round(flags / facts, 3), 0) as flag_rate
from (select distinct answer_id from te) a left join fa using (answer_id)"""
FACT_ROWS = f"""nn as (select *, count(*) over (partition by answer_id) as n, {kind('false')} as kind, {rivals(False)} from ki),
fr as materialized (select answer_id, pos, token, round(pos / n, 3) as position, kind, round(entropy, 4) as entropy, round(entropy / ln(3.0::double), 4) as norm_entropy, round(margin, 4) as margin, round(list_max(ps), 4) as top1_prob,
  round(ps[1], 4) as chosen_prob, numbers as competing_numbers, entities as competing_entities, near[1:5] as top_alts from nn where kind <> '')"""
ANSWERS = """ag as (select answer_id, least(count(*), 30) / 30 as n_fact, avg(norm_entropy) as mean_entropy, max(norm_entropy) as max_entropy, avg((norm_entropy > 0.15)::int::double) as high_ent_frac, avg(least(margin, 5.0::double) / 5) as mean_margin,
  min(least(margin, 5.0::double) / 5) as min_margin, avg(top1_prob) as mean_top1, avg(least(competing_numbers + competing_entities, 4) / 4) as competing from fr group by answer_id),
av as materialized (select c.conv_id * 1000 + c.turn as answer_id, coalesce(n_fact, 0.0) as n_fact, coalesce(mean_entropy, 0.0) as mean_entropy, coalesce(max_entropy, 0.0) as max_entropy, coalesce(high_ent_frac, 0.0) as high_ent_frac,
  coalesce(mean_margin, 1.0) as mean_margin, coalesce(min_margin, 1.0) as min_margin, coalesce(mean_top1, 1.0) as mean_top1, coalesce(competing, 0.0) as competing, 0.0::double as corruption, least(length(c.text), 800) / 800 as answer_len
  from conversations c left join ag on ag.answer_id = c.conv_id * 1000 + c.turn)"""

_similar = "(case when len(list_distinct(list_concat(x.key, c.key))) = 0 then 1.0 else len(list_intersect(x.key, c.key)) / len(list_distinct(list_concat(x.key, c.key))) end) >= 0.5"
_first = f"coalesce(list_position(list_transform(a.cl, lambda c: {_similar}), true), 0)"
CLUSTERS = f"""with k as (select conv_id as question_id, turn, list_distinct(list_concat(list_transform(regexp_extract_all(coalesce(text, ''), '-?[0-9]+(?:[.,][0-9]+)?'), lambda n: replace(n, ',', '.')),
  list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-zà-þ0-9]+'), lambda w: length(w) > 3))) as key from conversations),
l as (select question_id, list({{'key': key, 'cl': []::struct(key varchar[], size int)[]}} order by turn) as l from k group by question_id),
r as (select question_id, len(l) as n, list_transform(list_reduce(l, lambda a, x: {{'key': x.key, 'cl': case when {_first} > 0 then list_transform(a.cl, lambda c, i: {{'key': c.key, 'size': (c.size + case when i = {_first} then 1 else 0 end)::int}})
  else list_concat(a.cl, [{{'key': x.key, 'size': 1::int}}]) end}}, {{'key': []::varchar[], 'cl': []::struct(key varchar[], size int)[]}}).cl, lambda c: c.size) as c from l),
h as (select *, -list_sum(list_transform(c, lambda s: s / n * ln(s / n + 1e-12))) as h from r)
select question_id, round(h, 3) as semantic_entropy, round(h / case when n > 1 then ln(n) else 1.0 end, 3) as normalized, len(c)::bigint as n_clusters, n::bigint as n_samples, round(list_max(c) / n, 3) as agreement from h"""


def draw(key: str, salt: str, parts: int) -> str:
    return f"(('0x' || substr(md5({key} || ':{salt}'), 1, 7))::int % {parts})"


def among(options, n: str) -> str:
    return f"{listed(options)}[{n} + 1]"


_cell = f"case when {draw('key || (i * 100 + j)::varchar', 'cell', 10)} < 4 then printf('%.2f', {draw('key || (i * 100 + j)::varchar', 'value', 600)} / 100 - 3) else '0.00' end"
SYNTH = f"""with k as (select doc_id, text, length(text) as n, cls, doc_id::varchar || '/' || cls || '/0' as key from documents, (select unnest({listed(synth.CLASSES)}) as cls) where length(text) >= {synth.LEAST_CLEAN}),
o as (select *, floor(n * (0.7::double * {draw('key', 'onset', 10_000)} / 10000))::int as onset from k),
w as (select *, greatest({synth.LEAST_TAIL}, n - onset) as size, list_filter(regexp_split_to_array(substr(text, 1, greatest(onset, 200)), '[ \t\n\r]+'), lambda w: length(w) > 3) as words from o),
p as (select *, {draw('key', 'words', 1_000)} % greatest(len(words) - 3, 1) as start from w),
u as (select *, case cls when {quoted(synth.REPETITION)} then (case when len(words) >= 4 then array_to_string(words[start + 1:start + 4], ' ') else 'over and over again' end) || {among(synth.SEPARATORS, draw('key', 'separator', len(synth.SEPARATORS)))}
  when {quoted(synth.DRIFT)} then case when {draw('key', 'script', 10)} < 6 then {quoted(synth.HAN * 3)} else {quoted(synth.ARAB * 3)} end
  when {quoted(synth.REGURGITATION)} then case when {draw('key', 'page', 10)} < 6 then {quoted(synth.README)} else {quoted(synth.NEWS)} end
  else case when {draw('key', 'kind', 2)} = 0 then '#REF! ' || array_to_string(list_transform(range(1, 13), lambda i: {among(synth.LABELS, f'(i - 1) % {len(synth.LABELS)}')} || ' ' || array_to_string(list_transform(range(1, 16), lambda j: {_cell}), ' ') || ' '), '')
  else array_to_string(list_transform(range(1, 41), lambda i: {among(synth.SOUP, draw('key || i::varchar', 'soup', len(synth.SOUP)))}), '') end end as unit from p)
select key as stream_id, doc_id as source_id, substr(text, 1, onset) || substr(repeat(unit, (size // greatest(length(unit), 1) + 1)::int), 1, size) as text, 1 as label, onset as onset_char, cls as corruption_class from u"""

#: The period at which the last 800 characters agree most with themselves, and the last long run at that period.
LOOPS = """with t as (select doc_id as stream_id, text, length(text) as n, string_split(text, '') as c from documents),
e as (select stream_id, n, c[-800:] as e, least(n, 800) as m from t where n >= 24),
sh as (select stream_id, list_transform(range(8, least(240, m - 8) + 1), lambda p: list_sum(list_transform(range(1, m - p + 1), lambda i: (e[i] = e[i + p])::int)) / (m - p)) as s from e),
pe as (select stream_id, list_position(s, list_max(s)) + 7 as p from sh where list_max(s) >= 0.85),
eq as (select stream_id, n, p, unnest(range(0, n - p)) as i, unnest(list_transform(range(1, n - p + 1), lambda k: (c[k] = c[k + p])::int)) as same from t join pe using (stream_id)),
ru as (select stream_id, n, p, min(i) as start from (select *, i - row_number() over (partition by stream_id order by i) as g from eq where same = 1) group by stream_id, n, p, g having count(*) >= 2 * p),
la as (select stream_id, n, p, max(start) as start from ru group by stream_id, n, p),
lo as (select stream_id, start, instr(substr(text, start + 1, 200), ' ') as blank from la join t using (stream_id) where la.n - p - start >= 0.6 * least(600, la.n))
select t.stream_id, coalesce(start, -1)::bigint as loop_onset, case when start is null then text else substr(text, 1, (case when start < n and blank > 0 then start + blank else start end)::int) end as trimmed from t left join lo using (stream_id)"""
