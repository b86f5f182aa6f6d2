"""Logical tables derived from the test tables by fixed rules; ``k`` is the order or part key.

No rule draws at random, and the SQL twins state the same rules. Joins carry no hint: Spark broadcasts
a side only when its size is below the configured bound, and customers grow with the data.
"""

import datetime as dt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from workpulse import labels as L
from workpulse import schemas
from workpulse.checks import workbooks
from workpulse.plans import cases, payments, value_chain, versions
from workpulse.sources import records, sheets

AS_OF = dt.datetime(2001, 12, 31, 12)
LAST_DAY = AS_OF.date()
COMPANY = "ACME"
CHOSEN_VERSIONS = ("Anterior", "Nova")
# Choices of a user, null among them.
CHOSEN_CASES = {
    "status": ["Aberto", None],
    "gravidadeMaxima": ["Grave", "Leve"],
    "unidade": ["NATION_1", "NATION_7", "CEEM Boa Vista/Manaus", None],
    "mddCorretSelecionada": ["Suspensão", "Não informada"],
}
CHOSEN_UNITS = ["NATION_2", "Não informada", None]
CHOSEN_PAYMENTS = {"slaStatus": ["No Prazo"], "departamentoSolicitante": ["Financeiro", "Encomendas"]}
CHOSEN_CHAIN = {"Unidade": ["ASIA"], "Temporada": ["Baixa"], "Tipo de Procedimento": ["Apoio", "Gerencial"]}
# Cases looked up by their ids; the last is no case.
LOOKED_UP = ("1", "7", "1000", "14999", "none")
CHAIN_UNITS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")

# Every irregularity rule, then blank, explicit null, a field not given, and a code without a rule.
CODES = (
    "equivocosatividadesprocedimentos_leve",
    "ausenciasnaojustificadas_moderado",
    "equivocosdocumentosregistros_leve",
    "violacaonormasprocedimentos_moderado",
    "falsificacaodocumentos_grave",
    "recorrenciacondutasmoderadas_grave",
    "recorrenciacondutasleves_moderado",
    "usoexcessivocelular_moderado",
    "infracaotransitosuspensaocnh_grave",
    "infracaotransito_leve",
    "abandonoemprego_grave",
    "violacaopoliticasgrave_grave",
    "assediomoralsexual_grave",
    "embriaguezdrogas_grave",
    "desrespeitoseguranca_moderado",
    "desidia_grave",
    "usoimpropriorecursos_moderado",
    "atrasosfrequentesinjustificadosmoderado",
    "atrasosesporadicos_leve",
    "indefinido_outra",
    " ",
    None,
    "(omitted)",
    "apropriacaofurto_grave",
)
CODE_OMITTED = CODES.index("(omitted)")
CODE_NULL = CODES.index(None)
SEVERITY_TEXTS = ("leve", "Moderado", "Gravidade média", "GRAVE", " ", "Outra", "A Definir", None)
MEASURE_TEXTS = (
    "Suspensão por 3 dias",
    "Orientação Disciplinar verbal",
    "Advertência Escrita",
    "Desligamento (Justa Causa) - Desligamento (Justa Causa)",
    " ",
    "Outra Medida",
    None,
)
DEPARTMENT_TEXTS = tuple("X " + text.format(company=COMPANY) for text, _ in L.DEPARTMENT_RULES) + (
    "OUTRO SETOR",
    "",
    None,
)
SLA_TEXTS = ("on_time", "OVERDUE", "other")
FREQUENCY_TEXTS = (
    "Diário", " semanal ", "MENSAL", "Bimestral", "Trimestral", "Semestral", "Anual", "", "Quinzenal",
)
AUTOMATION_TEXTS = ("Manual", "Parcial", "Total", "", "NaN")
TYPE_TEXTS = ("Apoio", "Gerencial", "Operacional")
# State by line number 1-7; the second text is for line status O.
STATE_TEXTS = (
    ("Início", "Início"),
    ("Classificar Irregularidade", "Aprovar Desligamento"),
    ("Levantar os Fatos", "Realizar Parecer Jurídico"),
    ("Definir Medida Corretiva", "Realizar Parecer Técnico"),
    ("Fim", "Fim"),
    ("Arquivado", "Arquivado"),
    (None, None),
)


_SCHEMAS = {}


def table(spark: SparkSession, sf_dir, name) -> DataFrame:
    """A test table; its schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def pick(values, index: Column) -> Column:
    """The value at ``index`` of a fixed list."""
    return F.get(F.array(*[F.lit(value).cast("string") for value in values]), index.cast("int"))


def _orders(spark, sf_dir) -> DataFrame:
    """Orders with the names of their customer, nation and region."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(places.select("n_nationkey", "n_name", "r_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )


def _k() -> Column:
    return F.col("o_orderkey")


def _envelope():
    days = F.make_dt_interval((_k() % 13).cast("int"), (_k() % 24).cast("int"))
    start = F.col("o_orderdate").cast("timestamp_ntz")
    return {
        "processInstanceId": _k().cast("string"),
        "processId": F.when(_k() % 5 == 4, L.PAYMENT_PROCESS).otherwise(L.CASE_PROCESS),
        "status": F.when(F.col("o_orderstatus") == "F", "FINALIZED")
        .when(F.col("o_orderstatus") == "O", "Open")
        .otherwise("CANCELLED"),
        "startDate": start,
        "endDate": F.when(F.col("o_orderstatus") == "F", start + days),
    }


def _code_index() -> Column:
    return F.col("o_custkey") % len(CODES)


def _case_fields():
    return {
        "gravidadeMaxima": pick(SEVERITY_TEXTS, _k() % 8),
        "tbIrregularidade___1": F.when(_code_index() != CODE_OMITTED, pick(CODES, _code_index())),
        "irregularidade": F.when(_k() % 17 != 0, F.col("o_orderpriority")),
        "mddCorretSelecionada": pick(MEASURE_TEXTS, (_k() + F.col("o_custkey")) % 7),
        "unidade": F.when(F.col("n_name") == "NATION_3", "Filial CEEM Boa Vista - Manaus")
        .when(F.col("n_name") == "NATION_4", " ")
        .when(F.col("n_name") != "NATION_5", F.col("n_name")),
        "solicitante": F.col("c_mktsegment"),
        "prejFinanc": F.when(_k() % 5 == 0, "0")
        .when(_k() % 5 == 1, " ")
        .otherwise(F.format_number("o_totalprice", 2)),
        "cidadeFato": F.col("n_name"),
        "regiaoUnidade": F.col("r_name"),
        "nmInvestigado": F.col("c_name"),
        "descFato": F.lit("Descrição do fato"),
        "conclusao": F.lit(None).cast("string"),
    }


def _payment_fields():
    return {
        "departamentoSolicitante": pick(DEPARTMENT_TEXTS, _k() % len(DEPARTMENT_TEXTS)),
        "empresaPagamento": F.when(_k() % 19 != 0, F.col("r_name")),
        "unidadeSolicitante": F.when(_k() % 23 != 0, F.col("n_name")),
        "nomeSolicitante": F.when(_k() % 29 != 0, F.col("c_mktsegment")),
        "tpPagamento": F.when(_k() % 31 != 0, F.col("o_orderpriority")),
        "aprovarSolic": F.when(_k() % 4 == 0, "aprovado").otherwise("reprovado"),
        "funcaoSolicitante": F.concat(F.lit("Função "), (_k() % 7).cast("string")),
        "observacao": F.concat(F.lit("Observação "), (_k() % 11).cast("string")),
        "natureza": F.concat(F.lit("Natureza "), (_k() % 3).cast("string")),
        "codFornecedor": F.concat(F.lit("F"), (_k() % 97).cast("string")),
        "vencimento": F.concat(F.lit("dia "), (_k() % 28 + 1).cast("string")),
        "numTitulo": F.concat(F.lit("T"), _k().cast("string")),
        "numPedido": F.concat(F.lit("P"), _k().cast("string")),
        "nomeRazaoSocial": F.concat(F.lit("Razão "), (_k() % 97).cast("string")),
        "nomeFantasia": F.concat(F.lit("Fantasia "), (_k() % 97).cast("string")),
        "cpfCnpj": F.lit("00000000000000"),
    }


def _select(frame, columns):
    return frame.select(*[column.alias(name) for name, column in columns.items()])


def flat_cases(spark, sf_dir) -> DataFrame:
    """Cases as flattening leaves them: an explicit null code is blank, one not given is null."""
    fields = _case_fields()
    fields["tbIrregularidade___1"] = F.when(_code_index() == CODE_NULL, "").otherwise(fields["tbIrregularidade___1"])
    return _select(_orders(spark, sf_dir), _envelope() | fields)


def flat_payments(spark, sf_dir) -> DataFrame:
    sla = {"slaStatus": pick(SLA_TEXTS, _k() % 3)}
    return _select(_orders(spark, sf_dir), _envelope() | sla | _payment_fields())


def clean_cases(spark, sf_dir) -> DataFrame:
    return cases.clean_cases(flat_cases(spark, sf_dir), AS_OF)


def clean_payments(spark, sf_dir) -> DataFrame:
    return payments.clean_payments(flat_payments(spark, sf_dir), AS_OF, COMPANY)


def landed_cases(spark, sf_dir) -> DataFrame:
    """Cases with their form as an array, times as zoned text. The code may be missing from the form,
    and one form in six holds the applicant twice, the first one outdated."""
    fields = _case_fields()

    def item(name, value):
        return F.struct(F.lit(name).alias("field"), value.alias("value"))

    outdated = F.when(_k() % 6 == 0, F.array(item("solicitante", F.lit("antigo")))).otherwise(_no_items())
    code = "tbIrregularidade___1"
    maybe = F.when(_code_index() != CODE_OMITTED, F.array(item(code, fields[code]))).otherwise(_no_items())
    rest = F.array(*[item(name, value) for name, value in fields.items() if name != code])
    return _select(_orders(spark, sf_dir), _zoned_envelope() | {"formFields": F.concat(outdated, maybe, rest)})


def landed_payments(spark, sf_dir) -> DataFrame:
    form = [
        F.struct(F.lit(name).alias("field"), value.alias("value")) for name, value in _payment_fields().items()
    ]
    columns = _zoned_envelope() | {"slaStatus": pick(SLA_TEXTS, _k() % 3), "formFields": F.array(*form)}
    return _select(_orders(spark, sf_dir), columns)


def _no_items() -> Column:
    return F.array().cast("array<struct<field:string,value:string>>")


def _zoned_envelope():
    columns = _envelope()
    for name in ("startDate", "endDate"):
        columns[name] = F.concat(F.date_format(columns[name], "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-0300"))
    return columns


def record_texts(landed: DataFrame) -> DataFrame:
    """Each record as JSON text, explicit nulls written."""
    return landed.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def pages(landed: DataFrame, extra: Column | None = None, list_name="requests") -> DataFrame:
    """Each record on a page of its own, under its list, after the text ``extra`` if given."""
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    items = text if extra is None else F.concat(extra, F.lit(","), text)
    return landed.select(F.concat(F.lit(f'{{"{list_name}":['), items, F.lit("]}")).alias("page"))


def stray_texts() -> Column:
    """Texts that stand beside a record on its page and are no record themselves, by the case's id."""
    return pick(("17", '"solto"', "null", "[1,2]"), F.col("processInstanceId").cast("bigint") % 4)


# Kinds of landed pages, by the case's id: plain, with a stray, cut off, an error, no list under the list's name, and
# records without process or state.
PAGE_KINDS = 7


def mixed_pages(spark, sf_dir) -> DataFrame:
    """Pages of every kind, a case each."""
    landed = landed_cases(spark, sf_dir)
    kind = F.col("processInstanceId").cast("bigint") % PAGE_KINDS
    landed = landed.withColumn("processId", F.when(kind != 5, F.col("processId")))
    landed = landed.withColumn("status", F.when(kind != 6, F.col("status")))
    text = F.to_json(F.struct(*landed.columns), {"ignoreNullFields": "false"})
    page = (
        F.when(kind == 1, F.concat(F.lit('{"requests":['), stray_texts(), F.lit(","), text, F.lit("]}")))
        .when(kind == 2, F.concat(F.lit('{"requests":['), F.substring(text, 1, 40)))
        .when(kind == 3, F.lit('{"error":"denied"}'))
        .when(kind == 4, F.concat(F.lit('{"requests":'), text, F.lit("}")))
        .otherwise(F.concat(F.lit('{"requests":['), text, F.lit("]}")))
    )
    return landed.select(page.alias("page"))


# Each case is landed first, every second one again, every sixth one a third time, in the state that the case's id and the landing
# give. The days of landing are not in that order, and many tie. One case in 101 has no instance id.
LANDED_STATES = ("OPEN", "FINALIZED", "CANCELLED", "Open")
LANDED_AGAIN = (1, 2, 6)
FIRST_LANDING = "2001-01-01"


def landed_pages(spark, sf_dir, only=None) -> DataFrame:
    """Pages of a case each with the time and file of their landing; a case is landed up to three times. With ``only`` those of one landing."""
    landed = landed_cases(spark, sf_dir)
    if only is not None:  # so that orders are left out before they are joined
        landed = landed.where(F.col("processInstanceId").cast("bigint") % LANDED_AGAIN[only] == 0)
    k, number = F.col("processInstanceId").cast("bigint"), F.col("_landing")
    numbers = F.array_compact(F.array(*[F.when(k % every == 0, i) for i, every in enumerate(LANDED_AGAIN) if only in (None, i)]))
    again = landed.select("*", F.explode(numbers).alias("_landing"))
    status = pick(LANDED_STATES, (k + number) % len(LANDED_STATES))
    days = F.floor((k * 7 + number * 11) % 29 / 10).cast("int")
    changed = again.withColumns(
        {
            "_at": F.lit(FIRST_LANDING).cast("timestamp") + F.make_dt_interval(days),
            "status": status,
            "endDate": F.when(status == "FINALIZED", F.col("startDate")),
            "processInstanceId": F.when(k % 101 != 0, F.col("processInstanceId")),
        }
    )
    text = F.to_json(F.struct(*landed.columns), {"ignoreNullFields": "false"})
    page = F.concat(F.lit('{"requests":['), text, F.lit("]}")).alias("page")
    return changed.select(page, F.col("_at").alias(records.LANDED_AT), F.concat(F.lit("part-"), number).alias(records.LANDED_FILE))


# Form fields that nobody declared, by name: every how many cases give it. The last is given twice, first with an outdated value.
UNDECLARED = {"novoCampo": 4, "Observação interna": 10, "tbTestemunhas___1": 7, "prazo extra": 9}


def cases_with_other_fields(spark, sf_dir) -> DataFrame:
    """Cases whose forms hold fields that are not declared; one value in three is null, and one case in 13 has a field without a name."""
    landed, k = landed_cases(spark, sf_dir), F.col("processInstanceId").cast("bigint")

    def item(name, value):
        return F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"))

    last = list(UNDECLARED)[-1]
    items = [F.when(k % UNDECLARED[last] == 0, item(last, F.lit("antigo")))]
    items += [F.when(k % every == 0, item(name, F.when(k % 3 != 0, F.concat(F.lit("valor "), k)))) for name, every in UNDECLARED.items()]
    items.append(F.when(k % 13 == 0, item(None, F.lit("sem nome"))))
    return landed.withColumn("formFields", F.concat("formFields", F.array_compact(F.array(*items))))


def requests_from_pages(spark, sf_dir) -> DataFrame:
    rows = records.sound_records(records.unwrap(pages(landed_cases(spark, sf_dir))), schemas.REQUEST)
    asked = records.asked(rows, L.CASE_PROCESS, L.REQUESTED_STATUS)
    return records.with_times(records.flatten(asked, schemas.CASE_FIELDS))


def payments_from_pages(spark, sf_dir) -> DataFrame:
    rows = records.sound_records(records.unwrap(pages(landed_payments(spark, sf_dir))), schemas.PAYMENT)
    asked = records.asked(rows, L.PAYMENT_PROCESS, L.REQUESTED_STATUS)
    return records.with_times(records.flatten(asked, schemas.PAYMENT_FIELDS))


def activities(spark, sf_dir) -> DataFrame:
    """Activities with their state nested, a line each; a line without a state has a state without a name."""
    lines = table(spark, sf_dir, "lineitem")
    number = F.col("l_linenumber") - 1
    state = F.when(F.col("l_linestatus") == "O", pick([o for _, o in STATE_TEXTS], number)).otherwise(
        pick([f for f, _ in STATE_TEXTS], number)
    )
    start = F.col("l_shipdate").cast("timestamp_ntz")
    hours = F.make_dt_interval(F.lit(0), F.col("l_quantity").cast("int"))
    return lines.select(
        F.col("l_orderkey").cast("string").alias("processInstanceId"),
        F.struct(state.alias("stateName")).alias("state"),
        start.alias("startDate"),
        F.when(F.col("l_returnflag") != "N", start + hours).alias("endDate"),
    )


def clean_activities(spark, sf_dir) -> DataFrame:
    return cases.clean_activities(activities(spark, sf_dir), AS_OF)


def landed_activities(spark, sf_dir) -> DataFrame:
    """Pages of an activity each, times as zoned text; those of another process are among them."""
    rows = activities(spark, sf_dir)
    zoned = {name: F.concat(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-0300")) for name in ("startDate", "endDate")}
    other = F.array(F.lit(L.CASE_PROCESS), F.lit("outro"))
    both = rows.withColumns(zoned).withColumn("processId", F.explode(other))
    kept = (F.col("processId") == L.CASE_PROCESS) | (F.col("processInstanceId").cast("bigint") % 10 == 0)
    return pages(both.where(kept), list_name="activities")


def chain_wide(spark, sf_dir, dealt=False) -> DataFrame:
    """The value-chain sheet, every cell text; headers come padded and are trimmed on reading.

    A small file is one task's, whatever its rows unfold to; with ``dealt`` its rows are spread over all tasks first.
    """
    part = F.col("p_partkey")
    size = F.col("p_size")
    columns = {
        "Processo": F.col("p_type"),
        "Procedimento": F.col("p_brand"),
        "Atividade": F.col("p_name"),
        "Tarefa": part.cast("string"),
        "Tipo de Procedimento": pick(TYPE_TEXTS, size % 3),
    }
    for i, unit in enumerate(CHAIN_UNITS):
        for j, season in enumerate(L.SEASONS):
            prefix = L.SEASON_PREFIX[season]
            columns[f"{prefix}_FREQUÊNCIA {unit}"] = pick(FREQUENCY_TEXTS, (part + i + j) % 9)
            columns[f"{prefix}_VOLUME {unit}"] = (
                F.when((part + i) % 11 == 0, "").when((part + i) % 11 == 1, "1,5").otherwise((size + j).cast("string"))
            )
        columns[f"TEMPO (h) {unit}"] = F.when(part % 13 == 0, "n/d").otherwise((size / 8.0).cast("string"))
        columns[f"{L.AUTOMATION} {unit}"] = pick(AUTOMATION_TEXTS, (part + i) % 5)
    parts = table(spark, sf_dir, "part")
    padded = (parts.repartition("p_partkey") if dealt else parts).select(
        *[column.alias(f" {name} ") for name, column in columns.items()]
    )
    return sheets.tidy_headers(padded).na.fill("")


def chain_long(spark, sf_dir, carry=None) -> DataFrame:
    return value_chain.long(chain_wide(spark, sf_dir), carry)


def chain_filtered(spark, sf_dir) -> DataFrame:
    return value_chain.filtered(chain_long(spark, sf_dir))


def version_sheets(spark, sf_dir) -> dict[str, DataFrame]:
    """Three sheets of parts; the later two lack the column of notes that the first has."""
    part, name = F.col("p_partkey"), F.col("p_name")
    kind, brand = F.col("p_type"), F.col("p_brand")
    kept = {
        "Anterior": (part % 3 != 0) & (kind != "PROMO") & (brand != "Brand#7") & ~name.startswith("blue"),
        "Nova": (part % 4 != 1) & (kind != "ECONOMY") & (brand != "Brand#3") & ~name.startswith("red"),
        "Arquitetura": part % 5 != 2,
    }
    parts = table(spark, sf_dir, "part")
    built = {}
    for version, condition in kept.items():
        rows = parts.where(condition).select(
            kind.alias("Processo"),
            brand.alias("Procedimento"),
            F.when(part % 37 != 5, name).alias("Atividade"),
            F.when(part % 41 != 7, part.cast("string")).alias("Tarefa"),
            F.concat(F.lit("nota "), (part % 10).cast("string")).alias("Nota"),
        )
        built[version] = rows if version == "Anterior" else rows.drop("Nota")
    return built


def stacked_versions(spark, sf_dir) -> DataFrame:
    return sheets.stack_versions(version_sheets(spark, sf_dir))


def version_workbooks(spark, sf_dir, folder, parts=8) -> None:
    """The three sheets dealt to some workbooks, each written by one task: stand-ins of the landed file."""
    columns = {version: frame.columns for version, frame in version_sheets(spark, sf_dir).items()}
    stacked = stacked_versions(spark, sf_dir).withColumn("_book", F.pmod(F.hash("Processo", "Procedimento"), F.lit(parts)))
    dealt = stacked.repartition(parts, "_book").sortWithinPartitions("_book", "Versao")

    def written(batches):
        books = {}
        for batch in batches:
            for row in batch.to_pylist():
                sheet = books.setdefault(row["_book"], {version: [] for version in columns})[row["Versao"]]
                sheet.append([row[name] for name in columns[row["Versao"]]])
        for book, rows in books.items():
            workbooks.write(f"{folder}/{book:04d}.xlsx", {L.VERSION_SHEETS[version]: [names, *rows[version]] for version, names in columns.items()})
        yield pa.RecordBatch.from_arrays([pa.array(list(books), pa.int32())], ["book"])

    dealt.mapInArrow(written, "book int").write.format("noop").mode("overwrite").save()


def chosen_versions(spark, sf_dir) -> DataFrame:
    return versions.rows_of(stacked_versions(spark, sf_dir), CHOSEN_VERSIONS)
