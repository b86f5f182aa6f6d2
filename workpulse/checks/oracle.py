"""SQL twins of the queries, written for DuckDB over the raw test tables."""

from workpulse import labels as L
from workpulse import schemas
from workpulse.checks import fixtures as X
from workpulse.operators.filters import Offer
from workpulse.plans import cases, payments

NUDGE = 1e-9
AS_OF = f"TIMESTAMP '{X.AS_OF:%Y-%m-%d %H:%M:%S}'"
AFTER_LAST = "TIMESTAMP '2002-01-01 00:00:00'"
HOURS = f'"{L.DEMAND}"'
AUTO = f'"{L.AUTOMATION}"'
TYPE = '"Tipo de Procedimento"'


def _text(value):
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def _list(values):
    return ", ".join(_text(value) for value in values)


def _pick(values, index):
    whens = " ".join(f"WHEN {i} THEN {_text(value)}" for i, value in enumerate(values))
    return f"CASE {index} {whens} END"


def _rules(column, pairs, otherwise):
    whens = " ".join(f"WHEN contains({column}, {_text(part)}) THEN {_text(label)}" for part, label in pairs)
    return f"CASE {whens} ELSE {otherwise} END"


def _exact(column, pairs):
    return f"CASE lower({column}) " + " ".join(f"WHEN {_text(a)} THEN {_text(b)}" for a, b in pairs) + " END"


def _blank(column, missing):
    return f"CASE WHEN trim({column}) = '' THEN {_text(missing)} ELSE {column} END"


def _days(start, end):
    return f"epoch_us(coalesce({end}, {AS_OF}) - {start}) / 86400000000.0::DOUBLE"


def _r(expression, name, places=6):
    return f"round({expression} + {NUDGE}, {places}) AS {name}"


_BASE = f"""
base AS (
  SELECT o_orderkey AS k, o_custkey AS ck, o_totalprice, o_orderpriority, c_name, c_mktsegment, n_name, r_name,
    CAST(o_orderkey AS VARCHAR) AS "processInstanceId", o_orderdate AS "startDate",
    CASE WHEN o_orderstatus = 'F'
      THEN o_orderdate + to_days(CAST(o_orderkey % 13 AS INTEGER)) + to_hours(o_orderkey % 24) END AS "endDate",
    CASE o_orderstatus WHEN 'F' THEN 'FINALIZED' WHEN 'O' THEN 'Open' ELSE 'CANCELLED' END AS raw_status
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey)"""

_N = len(X.CODES)
_FLAT = f"""{_BASE},
flat AS (
  SELECT k, ck, "processInstanceId", "startDate", "endDate", raw_status AS status,
    {_pick(X.SEVERITY_TEXTS, 'k % 8')} AS "gravidadeMaxima",
    CASE WHEN ck % {_N} = {X.CODE_OMITTED} THEN NULL WHEN ck % {_N} = {X.CODE_NULL} THEN ''
      ELSE {_pick(X.CODES, f'ck % {_N}')} END AS "tbIrregularidade___1",
    CASE WHEN k % 17 <> 0 THEN o_orderpriority END AS irregularidade,
    {_pick(X.MEASURE_TEXTS, '(k + ck) % 7')} AS "mddCorretSelecionada",
    CASE n_name WHEN 'NATION_3' THEN 'Filial CEEM Boa Vista - Manaus' WHEN 'NATION_4' THEN ' '
      WHEN 'NATION_5' THEN NULL ELSE n_name END AS unidade,
    c_mktsegment AS solicitante,
    CASE k % 5 WHEN 0 THEN '0' WHEN 1 THEN ' ' ELSE format('{{:,.2f}}', o_totalprice) END AS "prejFinanc",
    n_name AS "cidadeFato", r_name AS "regiaoUnidade", c_name AS "nmInvestigado",
    'Descrição do fato' AS "descFato", CAST(NULL AS VARCHAR) AS conclusao
  FROM base)"""

_SEVERITY = _rules(
    'lower("gravidadeMaxima")',
    L.SEVERITY_RULES,
    f"""CASE WHEN trim("gravidadeMaxima") = '' OR contains(lower("gravidadeMaxima"), 'outra')
      THEN {_text(L.SEVERITY_MISSING)} ELSE lower("gravidadeMaxima") END""",
)
_MEASURE = _rules('"mddCorretSelecionada"', L.MEASURE_RULES, _blank('"mddCorretSelecionada"', L.MEASURE_MISSING))
_UNIT = _rules("unidade", L.UNIT_RULES, _blank("unidade", L.UNIT_MISSING))
_CODE = _rules('"tbIrregularidade___1"', L.IRREGULARITY_RULES, _blank('"tbIrregularidade___1"', L.UNDEFINED))
_LOSS = """nullif(TRY_CAST(replace("prejFinanc", ',', '') AS DOUBLE), 0)"""

_LABELLED = f"""{_FLAT},
labelled AS (
  SELECT k, "processInstanceId", "startDate", "endDate", {_days('"startDate"', '"endDate"')} AS lead_time,
    {_exact('status', L.STATUS)} AS status, {_SEVERITY} AS "gravidadeMaxima", {_CODE} AS "tbIrregularidade___1",
    irregularidade, {_MEASURE} AS "mddCorretSelecionada", {_UNIT} AS unidade, solicitante,
    {_LOSS} AS "prejFinanc", "cidadeFato", "regiaoUnidade", "nmInvestigado", "descFato", conclusao
  FROM flat),
clean AS (
  SELECT *, CASE
      WHEN "tbIrregularidade___1" = 'Indefinido/Outra' AND "gravidadeMaxima" IN ('Leve', 'Moderada')
        AND lead_time <= 3 THEN 'No Prazo'
      WHEN "tbIrregularidade___1" IS DISTINCT FROM 'Indefinido/Outra' AND "gravidadeMaxima" IN ('Leve', 'Moderada')
        AND lead_time <= 1 THEN 'No Prazo'
      WHEN "gravidadeMaxima" = 'Grave' AND lead_time <= 10 THEN 'No Prazo'
      ELSE 'Em Atraso' END AS "slaStatus"
  FROM labelled)"""

_IN_WINDOW = f"""("startDate" IS NOT NULL AND (("endDate" IS NULL AND "startDate" < {AFTER_LAST})
    OR "endDate" < {AFTER_LAST}))"""
_CASES = f"""WITH {_LABELLED},
f AS (SELECT * FROM clean WHERE "mddCorretSelecionada" IS NOT NULL
  AND "gravidadeMaxima" IN ({_list(L.SEVERITIES)}) AND {_IN_WINDOW})
"""

_DEPARTMENT_RULES = [(part.format(company=X.COMPANY), label) for part, label in L.DEPARTMENT_RULES]
_D = len(X.DEPARTMENT_TEXTS)
_PAYMENTS_CLEAN = f"""{_BASE},
pay AS (
  SELECT k, "processInstanceId", "startDate", "endDate", raw_status AS status,
    {_pick(X.SLA_TEXTS, 'k % 3')} AS "slaStatus",
    {_pick(X.DEPARTMENT_TEXTS, f'k % {_D}')} AS "departamentoSolicitante",
    CASE WHEN k % 19 <> 0 THEN r_name END AS "empresaPagamento",
    CASE WHEN k % 23 <> 0 THEN n_name END AS "unidadeSolicitante",
    CASE WHEN k % 29 <> 0 THEN c_mktsegment END AS "nomeSolicitante",
    CASE WHEN k % 31 <> 0 THEN o_orderpriority END AS "tpPagamento",
    CASE WHEN k % 4 = 0 THEN 'aprovado' ELSE 'reprovado' END AS "aprovarSolic",
    'Função ' || (k % 7) AS "funcaoSolicitante", 'Observação ' || (k % 11) AS observacao,
    'Natureza ' || (k % 3) AS natureza, 'F' || (k % 97) AS "codFornecedor", 'dia ' || (k % 28 + 1) AS vencimento,
    'T' || k AS "numTitulo", 'P' || k AS "numPedido", 'Razão ' || (k % 97) AS "nomeRazaoSocial",
    'Fantasia ' || (k % 97) AS "nomeFantasia", '00000000000000' AS "cpfCnpj"
  FROM base),
payclean AS (
  SELECT * REPLACE ({_exact('status', L.STATUS)} AS status, {_exact('"slaStatus"', L.SOURCE_SLA)} AS "slaStatus",
    {_rules('"departamentoSolicitante"', _DEPARTMENT_RULES,
            '''CASE WHEN "departamentoSolicitante" IS NOT NULL THEN 'não informado' END''')}
      AS "departamentoSolicitante"),
    {_days('"startDate"', '"endDate"')} AS lead_time
  FROM pay)"""
_PAYMENTS = f"""WITH {_PAYMENTS_CLEAN},
f AS (SELECT * FROM payclean WHERE status IS NOT NULL AND "slaStatus" IS NOT NULL AND "empresaPagamento" IS NOT NULL
  AND "unidadeSolicitante" IS NOT NULL AND "nomeSolicitante" IS NOT NULL AND "tpPagamento" IS NOT NULL
  AND "departamentoSolicitante" IS NOT NULL AND {_IN_WINDOW})
"""

_ACTIVITIES = f"""WITH act AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS "processInstanceId",
    coalesce(CASE WHEN l_linestatus = 'O' THEN {_pick([o for _, o in X.STATE_TEXTS], '(l_linenumber - 1)')}
      ELSE {_pick([f for f, _ in X.STATE_TEXTS], '(l_linenumber - 1)')} END, 'Desconhecido') AS "stateName",
    l_shipdate AS "startDate",
    CASE WHEN l_returnflag <> 'N' THEN l_shipdate + to_hours(CAST(l_quantity AS BIGINT)) END AS "endDate"
  FROM lineitem),
a AS (SELECT *, round_even({_days('"startDate"', '"endDate"')} * 100, 0) / 100 AS lead_time
  FROM act WHERE "stateName" IN ({_list(L.STATES)}))
"""


def _wide_columns():
    cells = []
    for i, unit in enumerate(X.CHAIN_UNITS):
        for j, season in enumerate(L.SEASONS):
            prefix = L.SEASON_PREFIX[season]
            cells.append((f"{prefix}_FREQUÊNCIA {unit}", _pick(X.FREQUENCY_TEXTS, f"(k + {i + j}) % 9")))
            volume = (
                f"CASE (k + {i}) % 11 WHEN 0 THEN '' WHEN 1 THEN '1,5' ELSE CAST(p_size + {j} AS VARCHAR) END"
            )
            cells.append((f"{prefix}_VOLUME {unit}", volume))
        cells.append(
            (f"TEMPO (h) {unit}", "CASE WHEN k % 13 = 0 THEN 'n/d' ELSE CAST(p_size / 8.0::DOUBLE AS VARCHAR) END")
        )
        cells.append((f"{L.AUTOMATION} {unit}", _pick(X.AUTOMATION_TEXTS, f"(k + {i}) % 5")))
    return cells


_WIDE = f"""wide AS (
  SELECT p_type AS "Processo", p_brand AS "Procedimento", p_name AS "Atividade", CAST(k AS VARCHAR) AS "Tarefa",
    {_pick(X.TYPE_TEXTS, 'p_size % 3')} AS {TYPE},
    {', '.join(f'{sql} AS "{name}"' for name, sql in _wide_columns())}
  FROM (SELECT *, p_partkey AS k FROM part))"""


def _number(column):
    text = f"trim({column})"
    guard = r"regexp_full_match(" + text + r", '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')"
    return f"CASE WHEN {guard} THEN TRY_CAST({text} AS DOUBLE) ELSE 0.0::DOUBLE END"


def _multiplier(column):
    whens = " ".join(f"WHEN {_text(name)} THEN {value}::DOUBLE" for name, value in L.FREQUENCIES)
    return f"CASE lower(trim({column})) {whens} ELSE 1.0::DOUBLE END"


def _unit_season(unit, season):
    prefix = L.SEASON_PREFIX[season]
    frequency, volume = f'"{prefix}_FREQUÊNCIA {unit}"', f'"{prefix}_VOLUME {unit}"'
    hours = f'"TEMPO (h) {unit}"'
    return f"""SELECT *, '{unit}' AS "Unidade", '{season}' AS "Temporada", "{L.AUTOMATION} {unit}" AS {AUTO},
    {frequency} AS "Frequência", {_number(volume)} AS "Volume", {_number(hours)} AS "{L.HOURS_EACH}",
    {_multiplier(frequency)} * {_number(volume)} * {_number(hours)} AS {HOURS} FROM wide"""


_LONG = f"""WITH {_WIDE},
long AS ({' UNION ALL '.join(_unit_season(unit, season) for unit in X.CHAIN_UNITS for season in L.SEASONS)}),
f AS (SELECT * FROM long WHERE "Processo" IS NOT NULL AND {TYPE} IS NOT NULL AND {AUTO} IS NOT NULL
  AND "Temporada" IN ('Alta', 'Baixa'))
"""
_LONG_OUT = f"""* REPLACE (round("Volume", 6) AS "Volume", round("{L.HOURS_EACH}", 6) AS "{L.HOURS_EACH}",
  round({HOURS}, 6) AS {HOURS})"""

_VERSION_COLUMNS = """p_type AS "Processo", p_brand AS "Procedimento",
  CASE WHEN p_partkey % 37 <> 5 THEN p_name END AS "Atividade",
  CASE WHEN p_partkey % 41 <> 7 THEN CAST(p_partkey AS VARCHAR) END AS "Tarefa\""""
_STACKED = f"""WITH stacked AS (
  SELECT {_VERSION_COLUMNS}, 'nota ' || (p_partkey % 10) AS "Nota", 'Anterior' AS "Versao" FROM part
    WHERE p_partkey % 3 <> 0 AND p_type <> 'PROMO' AND p_brand <> 'Brand#7' AND NOT starts_with(p_name, 'blue')
  UNION ALL SELECT {_VERSION_COLUMNS}, NULL, 'Nova' FROM part
    WHERE p_partkey % 4 <> 1 AND p_type <> 'ECONOMY' AND p_brand <> 'Brand#3' AND NOT starts_with(p_name, 'red')
  UNION ALL SELECT {_VERSION_COLUMNS}, NULL, 'Arquitetura' FROM part WHERE p_partkey % 5 <> 2)
"""
_CHOSEN = f"""{_STACKED.rstrip()},
v AS (SELECT * FROM stacked WHERE "Versao" IN ({_list(X.CHOSEN_VERSIONS)})
  AND "Processo" IS NOT NULL AND "Procedimento" IS NOT NULL AND "Atividade" IS NOT NULL)
"""


def _side(component, number):
    return (
        f"""SELECT DISTINCT '{component}' AS "Componente", "{component}" AS "Valor" FROM v"""
        f""" WHERE "Versao" = '{X.CHOSEN_VERSIONS[number]}' AND "{component}" IS NOT NULL"""
    )


_SETS = f"""{_CHOSEN.rstrip()},
one AS ({' UNION ALL '.join(_side(component, 0) for component in L.COMPONENTS)}),
two AS ({' UNION ALL '.join(_side(component, 1) for component in L.COMPONENTS)}),
kept AS (SELECT * FROM one INTERSECT SELECT * FROM two),
removed AS (SELECT * FROM one EXCEPT SELECT * FROM two),
new AS (SELECT * FROM two EXCEPT SELECT * FROM one)
"""


def _set_count(name, component):
    return f"""(SELECT count(*) FROM {name} WHERE "Componente" = '{component}')"""


_DIFF = f"""{_SETS.rstrip()},
d AS ({' UNION ALL '.join(
    f'''SELECT '{c}' AS "Componente", {_set_count('kept', c)} AS "Mantidos", {_set_count('removed', c)} AS "Removidos",
    {_set_count('new', c)} AS "Novos"''' for c in L.COMPONENTS)})
"""

_CASE_KPIS = f"""count(*) AS total, count_if(status = 'Finalizado')::BIGINT AS finished,
  count_if(status = 'Aberto')::BIGINT AS open, count_if("slaStatus" = 'No Prazo')::BIGINT AS on_time,
  count_if("slaStatus" = 'Em Atraso')::BIGINT AS late, {_r('avg(lead_time)', 'mean_lead')},
  {_r('coalesce(sum("prejFinanc"), 0.0)', 'total_loss', 2)}"""


def _count(source, keys, name="total", also="TRUE"):
    columns = ", ".join(keys)
    given = " AND ".join([f"{key} IS NOT NULL" for key in keys] + [also])
    return f"{source} SELECT {columns}, count(*) AS {name} FROM f WHERE {given} GROUP BY {columns}"


def _rank(source, key, measure, name, table="f"):
    return f"""{source} SELECT {key}, round(m + 1e-9, 6) AS {name}, row_number() OVER (ORDER BY m DESC NULLS LAST, {key})
      AS ranking FROM (SELECT {key}, {measure} AS m FROM {table} WHERE {key} IS NOT NULL GROUP BY {key})"""


def _rank_count(source, key):
    return _rank(source, key, "count(*)", "total").replace("round(m + 1e-9, 6)", "m")


def _mean(source, key, table="f"):
    return f"""{source} SELECT {key}, {_r('avg(lead_time)', 'lead_time')} FROM {table}
      WHERE {key} IS NOT NULL GROUP BY {key}"""


def _sum(keys):
    columns = ", ".join(keys)
    return f"{_LONG} SELECT {columns}, {_r(f'sum({HOURS})', HOURS)} FROM f GROUP BY {columns}"


def _before_after(source, table, clean, column):
    """Raw and clean column, joined on the key."""
    return f"""WITH {source} SELECT r."processInstanceId", r.{column} AS raw, c.{column} AS clean
      FROM {table} r JOIN {clean} c ON r.k = c.k"""


def _top(column, n):
    return f"""{_LONG}, s AS (SELECT "{column}", "Temporada", sum({HOURS}) AS h FROM f GROUP BY ALL),
      t AS (SELECT "{column}", row_number() OVER (ORDER BY round(h, 6) DESC, "{column}") AS position
        FROM s WHERE "Temporada" = 'Alta' QUALIFY position <= {n})
      SELECT s."{column}", CAST(position AS INTEGER) AS position, "Temporada", {_r('h', HOURS)}
      FROM s JOIN t ON s."{column}" = t."{column}" """


def _options(page, table, choices):
    parts = []
    for choice in choices:
        if choice.offer is Offer.FIXED:
            rows = f"SELECT unnest([{_list(choice.domain)}]) AS value"
        else:
            given = f' WHERE "{choice.column}" IS NOT NULL' if choice.offer is Offer.NOT_NULL else ""
            rows = f'SELECT DISTINCT "{choice.column}" AS value FROM {table}{given}'
        parts.append(f"SELECT '{page}' AS page, '{choice.column}' AS field, value FROM ({rows})")
    return " UNION ALL ".join(parts)


def _monthly(measure, name):
    return f"""{_CASES}, g AS (SELECT date_trunc('month', "startDate") AS m, {measure} AS v FROM f GROUP BY 1)
      SELECT strftime(last_day(CAST(months AS DATE)), '%Y-%m-%d') AS month_end, coalesce(v, 0) AS {name}
      FROM (SELECT unnest(generate_series((SELECT min(m) FROM g), (SELECT max(m) FROM g), INTERVAL 1 MONTH)) AS months)
      LEFT JOIN g ON m = months"""


_FLAT_OUT = """"processInstanceId", "startDate", "endDate", status, "gravidadeMaxima", "tbIrregularidade___1",
  irregularidade, "mddCorretSelecionada", unidade, solicitante, "prejFinanc", "cidadeFato", "regiaoUnidade",
  "nmInvestigado", "descFato", conclusao"""
_FLAT_IDS = "CASE WHEN k % 5 = 4 THEN 'ARF-SolicitaçãodePagamentoAntecipado' ELSE 'ElaborarRelatoriodeSindicancia' END"


def _shown_day(column, missing=""):
    return f"""coalesce(strftime({column}, '%d/%m/%Y'), '{missing}')"""


def _detail(pairs, shown):
    return ", ".join(f'{shown.get(name, chr(34) + name + chr(34))} AS "{heading}"' for name, heading in pairs)


_DAYS_SHOWN = {"startDate": _shown_day('"startDate"'), "endDate": _shown_day('"endDate"'),
               "lead_time": "round(lead_time, 6)"}
_CASE_SHOWN = _DAYS_SHOWN | {"prejFinanc": """'R$' || coalesce(format('{:,.2f}', "prejFinanc"), 'nan')"""}

_FIRST = """(SELECT * FROM f ORDER BY "startDate" NULLS LAST, "processInstanceId" LIMIT 1)"""
_CASE_CARDS = f"""{_CASES} SELECT "processInstanceId", {_shown_day('"startDate"', 'N/A')} AS "startDate",
  {_shown_day('"endDate"', 'N/A')} AS "endDate", format('{{:.3f}}', lead_time) || ' dias' AS lead_time, status,
  "slaStatus", unidade, "cidadeFato", "regiaoUnidade", "tbIrregularidade___1", "gravidadeMaxima", "nmInvestigado",
  solicitante, 'R$' || coalesce(format('{{:.2f}}', "prejFinanc"), 'nan') AS "prejFinanc", "descFato", conclusao"""
_PAYMENT_CARDS = f"""{_PAYMENTS} SELECT "processInstanceId", {_shown_day('"startDate"', 'N/A')} AS "startDate",
  {_shown_day('"endDate"', 'N/A')} AS "endDate", format('{{:.1f}}', lead_time) || ' dias' AS lead_time, status,
  "slaStatus", "unidadeSolicitante", "tpPagamento", "empresaPagamento", "departamentoSolicitante",
  "nomeSolicitante", "funcaoSolicitante", observacao"""


def _chosen(choices):
    """The user's choices as a condition; null is a choice like any other."""
    kept = []
    for column, values in choices.items():
        known = f'"{column}" IN ({_list([value for value in values if value is not None])})'
        kept.append(f'({known} OR "{column}" IS NULL)' if None in values else known)
    return " AND ".join(kept)


_LANDED = f"""{_FLAT}, again AS (
  SELECT *, unnest([{", ".join(f"CASE WHEN k % {every} = 0 THEN {i} END" for i, every in enumerate(X.LANDED_AGAIN))}]) AS landing FROM flat
), landed AS (
  SELECT k, CASE WHEN k % 101 <> 0 THEN "processInstanceId" END AS "processInstanceId", k % 5 <> 4 AS ours, landing,
    {_pick(X.LANDED_STATES, f"(k + landing) % {len(X.LANDED_STATES)}")} AS status, "startDate", unidade, solicitante,
    DATE '{X.FIRST_LANDING}' + CAST(((k * 7 + landing * 11) % 29) // 10 AS INTEGER) AS day
  FROM again WHERE landing IS NOT NULL
), ordered AS (
  SELECT *, "processInstanceId" IS NULL OR row_number() OVER (PARTITION BY k ORDER BY day DESC, landing DESC) = 1 AS last FROM landed
)"""

_OTHERS = list(X.UNDECLARED)
_EVERY = X.UNDECLARED
_UNDECLARED = " UNION ALL ".join(
    [
        f"""SELECT {_text(name)} AS field, count(*) AS records, count(*) FILTER (k % 3 <> 0) AS valued,
      {"count(*)" if name == _OTHERS[-1] else "0::BIGINT"} AS repeated FROM flat WHERE k % {every} = 0"""
        for name, every in _EVERY.items()
    ]
    + ["SELECT NULL, count(*), count(*), 0::BIGINT FROM flat WHERE k % 13 = 0"]
)
# Declared fields of the stand-in forms are given in every case, but for the code; those that may be null have a value in part of the cases.
_DECLARED = " UNION ALL ".join(
    f"""SELECT {_text(name)} AS field, count(*) AS records, count("{name}") AS valued,
      {"count(*) FILTER (k % 6 = 0)" if name == "solicitante" else "0::BIGINT"} AS repeated FROM given"""
    + (f" WHERE ck % {_N} <> {X.CODE_OMITTED}" if name == "tbIrregularidade___1" else "")
    for name in schemas.CASE_FIELDS
)

SQL = {
    "src_requests": f"""WITH {_FLAT} SELECT {_FLAT_OUT} FROM flat WHERE k % 5 <> 4
      AND upper(status) IN ('OPEN', 'FINALIZED')""",
    "src_payments": f"""WITH {_PAYMENTS_CLEAN} SELECT * EXCLUDE (k) FROM pay WHERE k % 5 = 4
      AND upper(status) IN ('OPEN', 'FINALIZED')""",
    "bad_records": f"""WITH kinds AS (SELECT o_orderkey % {X.PAGE_KINDS} AS kind FROM orders), ends AS (
      SELECT unnest(CASE kind WHEN 0 THEN ['sound'] WHEN 1 THEN ['sound', 'stray element'] WHEN 2 THEN ['broken page']
        WHEN 5 THEN ['no process id'] WHEN 6 THEN ['no status'] ELSE ['no list'] END) AS outcome FROM kinds)
      SELECT outcome, count(*) AS total FROM ends GROUP BY outcome""",
    "landed_again": f"""WITH {_LANDED} SELECT "processInstanceId", status, "startDate", CASE status WHEN 'FINALIZED' THEN "startDate" END AS "endDate",
      unidade, solicitante, strftime(day, '%Y-%m-%d') AS "landedAt", 'part-' || landing AS "landedFile"
      FROM ordered WHERE last AND ours AND upper(status) IN ('OPEN', 'FINALIZED')""",
    "landing_outcomes": f"""WITH {_LANDED} SELECT CASE WHEN last THEN 'sound' ELSE 'superseded' END AS outcome, count(*) AS total
      FROM ordered GROUP BY ALL""",
    "loaded_in_steps": f"""WITH {_LANDED}, steps AS (
        SELECT *, "processInstanceId" IS NULL OR row_number() OVER (PARTITION BY k ORDER BY landing DESC) = 1 AS newest FROM landed)
      SELECT "processInstanceId", status, "startDate", CASE status WHEN 'FINALIZED' THEN "startDate" END AS "endDate", unidade, solicitante, landing
      FROM steps WHERE newest AND ours AND upper(status) IN ('OPEN', 'FINALIZED')""",
    "undeclared_fields": f"WITH {_FLAT} {_UNDECLARED}",
    "field_census": f"""WITH {_FLAT}, given AS (SELECT * REPLACE (CASE WHEN ck % {_N} <> {X.CODE_NULL} THEN "tbIrregularidade___1" END AS "tbIrregularidade___1")
      FROM flat) SELECT field, false AS declared, records, valued, repeated FROM ({_UNDECLARED})
      UNION ALL SELECT field, true, records, valued, repeated FROM ({_DECLARED})""",
    "other_fields": f"""WITH {_FLAT} SELECT "processInstanceId", solicitante,
      {", ".join(f"CASE WHEN k % {_EVERY[name]} = 0 AND k % 3 <> 0 THEN 'valor ' || k END AS " + chr(34) + name + chr(34) for name in ("novoCampo", "prazo extra"))},
      concat_ws('; ', {", ".join(f"CASE WHEN k % {_EVERY[name]} = 0 THEN {_text(name + '=')} || CASE WHEN k % 3 <> 0 THEN 'valor ' || k ELSE '(null)' END END"
        for name in _OTHERS[1:3])}) AS rest FROM flat""",
    "flatten_requests": f'WITH {_FLAT} SELECT {_FLAT_OUT}, {_FLAT_IDS} AS "processId" FROM flat',
    "activities_clean": f"{_ACTIVITIES} SELECT * REPLACE (round(lead_time, 6) AS lead_time) FROM a",
    "src_wide": f"WITH {_WIDE} SELECT * FROM wide",
    "versions_stacked": f"{_STACKED} SELECT * FROM stacked",
    "lead_time": f"""WITH {_LABELLED} SELECT "processInstanceId", "startDate", "endDate",
      {_r('lead_time', 'lead_time')} FROM clean""",
    "loss_clean": _before_after(_LABELLED, "flat", "clean", '"prejFinanc"').replace(
        'c."prejFinanc" AS', 'round(c."prejFinanc", 6) AS'
    ),
    "severity_norm": _before_after(_LABELLED, "flat", "clean", '"gravidadeMaxima"'),
    "measure_norm": _before_after(_LABELLED, "flat", "clean", '"mddCorretSelecionada"'),
    "unit_norm": _before_after(_LABELLED, "flat", "clean", "unidade"),
    "irregularity_norm": _before_after(_LABELLED, "flat", "clean", '"tbIrregularidade___1"'),
    "status_norm": _before_after(_LABELLED, "flat", "clean", "status"),
    "sla_source_norm": _before_after(_PAYMENTS_CLEAN, "pay", "payclean", '"slaStatus"'),
    "sla_status": f"""WITH {_LABELLED} SELECT "processInstanceId", "gravidadeMaxima", "tbIrregularidade___1",
      {_r('lead_time', 'lead_time')}, "slaStatus" FROM clean""",
    "department_norm": _before_after(_PAYMENTS_CLEAN, "pay", "payclean", '"departamentoSolicitante"'),
    "filter_options": f"""WITH {_LABELLED}, {_PAYMENTS_CLEAN.replace(_BASE + ',', '')}, {_WIDE},
      autos AS ({' UNION ALL '.join(
          f'''SELECT '{u}' AS "Unidade", "{L.AUTOMATION} {u}" AS {AUTO} FROM wide''' for u in X.CHAIN_UNITS)})
      {_options('cases', 'clean', cases.CHOICES)} UNION ALL {_options('payments', 'payclean', payments.CHOICES)}
      UNION ALL SELECT 'value_chain', 'Processo', "Processo" FROM (SELECT DISTINCT "Processo" FROM wide)
      UNION ALL SELECT 'value_chain', 'Tipo de Procedimento', {TYPE} FROM (SELECT DISTINCT {TYPE} FROM wide)
      UNION ALL SELECT 'value_chain', 'Unidade', "Unidade" FROM (SELECT DISTINCT "Unidade" FROM autos)
      UNION ALL SELECT 'value_chain', '{L.AUTOMATION}', {AUTO} FROM (SELECT DISTINCT {AUTO} FROM autos)
      UNION ALL SELECT 'value_chain', 'Temporada', unnest(['Alta', 'Baixa'])""",
    "window_filter": f"""WITH {_LABELLED} SELECT "processInstanceId", "startDate", "endDate" FROM clean
      WHERE "startDate" >= TIMESTAMP '1996-03-01 00:00:00'
        AND (("endDate" IS NULL AND "startDate" <= TIMESTAMP '1999-06-30 23:59:59.999999')
          OR "endDate" <= TIMESTAMP '1999-06-30 23:59:59.999999')""",
    "window_bounds": """SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, '2001-12-31' AS last_day
      FROM orders""",
    "case_one": f"{_CASE_CARDS} FROM {_FIRST}",
    "case_cards": f"{_CASE_CARDS} FROM f",
    "kpi_chosen": f"{_CASES} SELECT {_CASE_KPIS} FROM f WHERE {_chosen(X.CHOSEN_CASES)}",
    "kpi_units": f"""WITH {_LABELLED} SELECT {_CASE_KPIS} FROM clean
      WHERE {_IN_WINDOW} AND {_chosen({"unidade": X.CHOSEN_UNITS})}""",
    "payments_chosen": _count(_PAYMENTS, ['"unidadeSolicitante"'], also=_chosen(X.CHOSEN_PAYMENTS)),
    "vc_chosen": f"""{_LONG} SELECT "Unidade", {TYPE}, {_r(f'sum({HOURS})', HOURS)} FROM f
      WHERE {_chosen(X.CHOSEN_CHAIN)} GROUP BY ALL""",
    "kpi_general": f"WITH {_LABELLED} SELECT {_CASE_KPIS} FROM clean WHERE {_IN_WINDOW}",
    "kpi_general_by_unit": f"WITH {_LABELLED} SELECT unidade, {_CASE_KPIS} FROM clean WHERE {_IN_WINDOW} GROUP BY unidade",
    "kpi_filtered": f"{_CASES} SELECT {_CASE_KPIS} FROM f",
    "cases_by_unit": _count(_CASES, ["unidade"]),
    "irregularity_by_unit": _count(_CASES, ["unidade", "irregularidade", '"gravidadeMaxima"'], "frequency"),
    "severity_totals": f"""{_CASES} SELECT count(*) AS total, count_if("gravidadeMaxima" = 'Grave')::BIGINT AS grave,
      count_if("gravidadeMaxima" = 'Moderada')::BIGINT AS moderate,
      count_if("gravidadeMaxima" = 'Leve')::BIGINT AS light FROM f""",
    "lead_by_unit": _mean(_CASES, "unidade"),
    "measures_by_unit": _count(_CASES, ["unidade", '"mddCorretSelecionada"']),
    "rank_units": _rank_count(_CASES, "unidade"),
    "rank_irregularities": _rank_count(_CASES, '"tbIrregularidade___1"'),
    "rank_measures": _rank_count(_CASES, '"mddCorretSelecionada"'),
    "rank_lead_units": _rank(_CASES, "unidade", "avg(lead_time)", "mean_lead"),
    "lead_by_task": _mean(_ACTIVITIES, '"stateName"', "a"),
    "rank_lead_tasks": _rank(_ACTIVITIES, '"stateName"', "avg(lead_time)", "mean_lead", "a"),
    "case_timeline": f"""{_CASES}, {_ACTIVITIES.replace('WITH ', '', 1)}
      SELECT "processInstanceId", "stateName", "startDate", "endDate" FROM a
      WHERE "processInstanceId" IN (SELECT "processInstanceId" FROM f)""",
    "case_detail": f"{_CASES} SELECT {_detail(L.CASE_DETAIL, _CASE_SHOWN)} FROM f",
    "payment_kpis": f"""{_PAYMENTS} SELECT count(*) AS total, count_if(status = 'Finalizado')::BIGINT AS finished,
      count_if(status = 'Aberto')::BIGINT AS open, count_if("aprovarSolic" = 'aprovado')::BIGINT AS approved,
      {_r('avg(lead_time)', 'mean_lead')} FROM f""",
    "payments_by_unit": _count(_PAYMENTS, ['"unidadeSolicitante"']),
    "payments_by_department": _count(_PAYMENTS, ['"departamentoSolicitante"']),
    "payment_lead_by_unit": _mean(_PAYMENTS, '"unidadeSolicitante"'),
    "rank_payment_units": _rank_count(_PAYMENTS, '"unidadeSolicitante"'),
    "rank_departments": _rank_count(_PAYMENTS, '"departamentoSolicitante"'),
    "rank_payment_lead": _rank(_PAYMENTS, '"unidadeSolicitante"', "avg(lead_time)", "mean_lead"),
    "payment_one": f"{_PAYMENT_CARDS} FROM {_FIRST}",
    "payment_cards": f"{_PAYMENT_CARDS} FROM f",
    "payment_detail": f"{_PAYMENTS} SELECT {_detail(L.PAYMENT_DETAIL, _DAYS_SHOWN)} FROM f",
    "vc_long": f"{_LONG} SELECT {_LONG_OUT} FROM long",
    "vc_filtered": f"{_LONG} SELECT {_LONG_OUT} FROM f",
    "vc_kpis": f"""{_LONG} SELECT {_r(f'sum({HOURS})', 'total_hours')}, count(DISTINCT "Unidade") AS units,
      count(DISTINCT "Processo") AS processes, count(DISTINCT "Procedimento") AS procedures,
      count(DISTINCT "Atividade") AS activities, count(DISTINCT "Tarefa") AS tasks FROM f""",
    "season_ratio": f"""{_LONG}, s AS (SELECT coalesce(sum({HOURS}) FILTER ("Temporada" = 'Alta'), 0.0) AS h,
        coalesce(sum({HOURS}) FILTER ("Temporada" = 'Baixa'), 0.0) AS l FROM f)
      SELECT round(h, 6) AS high_hours, round(l, 6) AS low_hours,
        round((h / nullif(l, 0) - 1) * 100 + 1e-9, 6) AS ratio_percent FROM s""",
    "hours_by_unit": _sum(['"Unidade"']),
    "hours_by_type": f"""{_LONG}, s AS (SELECT {TYPE}, sum({HOURS}) AS h FROM f GROUP BY 1)
      SELECT {TYPE}, round(h, 6) AS {HOURS}, round(h / sum(h) OVER () + 1e-9, 6) AS share FROM s""",
    "hours_by_unit_type": _sum(['"Unidade"', TYPE]),
    "automation_count": f"""{_LONG}, s AS (SELECT {AUTO}, count(*) AS total FROM f WHERE lower({AUTO}) <> 'nan' GROUP BY 1)
      SELECT {AUTO}, total, round(total / (sum(total) OVER ())::DOUBLE + 1e-9, 6) AS share FROM s""",
    "automation_mean": f"""{_LONG} SELECT {AUTO}, {_r(f'avg({HOURS})', 'mean_hours')} FROM f GROUP BY 1""",
    "hierarchy_hours": f"""{_LONG}, s AS (SELECT "Processo", "Procedimento", "Atividade", "Tarefa", sum({HOURS}) AS h
        FROM f WHERE "Procedimento" IS NOT NULL AND "Atividade" IS NOT NULL AND "Tarefa" IS NOT NULL GROUP BY ALL)
      SELECT CAST(4 - bit_count(grouping("Processo", "Procedimento", "Atividade", "Tarefa")) AS INTEGER) AS level,
        "Processo", "Procedimento", "Atividade", "Tarefa", round(sum(h), 6) AS hours,
        round(sum(h * h) / nullif(sum(h), 0) + 1e-9, 6) AS color
      FROM s GROUP BY ROLLUP ("Processo", "Procedimento", "Atividade", "Tarefa")""",
    "top_processes": _top("Processo", 6),
    "top_procedures": _top("Procedimento", 6),
    "top_activities": _top("Atividade", 10),
    "staffing": f"""{_LONG}, s AS (SELECT "Unidade", sum({HOURS}) AS h FROM f GROUP BY 1)
      SELECT "Unidade", round(h, 6) AS {HOURS}, ceil(round(h, 6) / 200) AS "Colaboradores_Necessarios" FROM s""",
    "staffing_long": f"""{_LONG}, s AS (SELECT "Unidade", sum({HOURS}) AS h FROM f GROUP BY 1)
      SELECT "Unidade", '{L.DEMAND}' AS "Métrica", round(h, 6) AS "Valor" FROM s
      UNION ALL SELECT "Unidade", 'Colaboradores_Necessarios', ceil(round(h, 6) / 200) FROM s""",
    "version_metrics": f"""{_CHOSEN} SELECT "Versao", count(DISTINCT "Processo") AS "Qtd_Processos",
      count(DISTINCT "Procedimento") AS "Qtd_Procedimentos", count(DISTINCT "Atividade") AS "Qtd_Atividades",
      count(DISTINCT "Tarefa") AS "Qtd_Tarefas" FROM v GROUP BY 1""",
    "hierarchy_versions": f"""{_CHOSEN}
      SELECT "Versao", 2 AS level, "Processo", "Procedimento", count("Atividade") AS "Qtd_Atividade" FROM v GROUP BY 1, 3, 4
      UNION ALL SELECT "Versao", 1, "Processo", NULL, count("Atividade") FROM v GROUP BY 1, 3
      UNION ALL SELECT "Versao", 0, NULL, NULL, count("Atividade") FROM v GROUP BY 1""",
    "version_diff": f"{_DIFF} SELECT * FROM d",
    "version_diff_long": f"""{_DIFF} SELECT "Componente", 'Mantidos' AS "Status", "Mantidos" AS "Quantidade" FROM d
      UNION ALL SELECT "Componente", 'Removidos', "Removidos" FROM d
      UNION ALL SELECT "Componente", 'Novos', "Novos" FROM d""",
    "version_gap": f"""{_SETS} SELECT *, 'Mantido' AS "Status" FROM kept UNION ALL SELECT *, 'Removido' FROM removed
      UNION ALL SELECT *, 'Novo' FROM new""",
    "version_rows": f"{_CHOSEN} SELECT * FROM v",
    "cases_by_city": _count(_CASES, ['"cidadeFato"']),
    "cases_by_region": _count(_CASES, ['"regiaoUnidade"']),
    "irregularity_by_place": f"""{_CASES}, p AS (
        SELECT 'cidade' AS place_kind, "cidadeFato" AS place, irregularidade, "gravidadeMaxima" FROM f
        UNION ALL SELECT 'região', "regiaoUnidade", irregularidade, "gravidadeMaxima" FROM f)
      SELECT *, count(*) AS frequency FROM p WHERE place IS NOT NULL AND irregularidade IS NOT NULL GROUP BY ALL""",
    "irregularity_severity": _count(_CASES, ["irregularidade", '"gravidadeMaxima"'], "frequency"),
    "measures_by_city": _count(_CASES, ['"cidadeFato"', '"mddCorretSelecionada"']),
    "sla_share": f"""{_CASES}, p AS (SELECT 'slaStatus' AS kind, "slaStatus" AS label FROM f
        UNION ALL SELECT 'status', status FROM f)
      SELECT kind, label, count(*) AS total, round(count(*) / (SELECT count(*) FROM f)::DOUBLE + 1e-9, 6) AS share
      FROM p GROUP BY 1, 2""",
    "monthly_cases": _monthly("count(*)", "total"),
    "monthly_loss": _monthly('round(coalesce(sum("prejFinanc"), 0.0), 2)', "loss"),
    "severity_pivot": f"""{_CASES} SELECT irregularidade, {', '.join(
        f'''count_if("gravidadeMaxima" = '{s}')::BIGINT AS "{s}"''' for s in L.SEVERITIES)}
      FROM f WHERE irregularidade IS NOT NULL GROUP BY 1""",
    "rank_cities": _rank_count(_CASES, '"cidadeFato"'),
}

# Other ways to the same rows.
_IDS = f""""processInstanceId" IN ({_list(X.LOOKED_UP)})"""
SQL["outcomes_observed"] = SQL["bad_records"]
SQL["report_kept"] = SQL["kpi_general_by_unit"]
SQL["cases_looked_up"] = f"{SQL['case_cards']} WHERE {_IDS}"
SQL["timeline_looked_up"] = f"{SQL['case_timeline']} AND {_IDS}"
SQL["versions_from_workbooks"] = SQL["versions_stacked"]
SQL["kpi_from_states"] = SQL["kpi_general_by_unit"]
SQL["vc_kpis_bitmaps"] = SQL["vc_kpis"]
SQL["vc_kpis_chosen_bitmaps"] = f"{SQL['vc_kpis']} WHERE {_chosen(X.CHOSEN_CHAIN)}"
SQL["src_activities"] = SQL["activities_clean"]
SQL["sheet_from_csv"] = SQL["src_wide"]
SQL["versions_from_csv"] = SQL["versions_stacked"]
SQL["detail_from_csv"] = SQL["case_detail"]
SQL["kpi_from_parquet"] = SQL["kpi_filtered"]
