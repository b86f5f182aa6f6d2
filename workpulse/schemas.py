"""Schemas of the landed tables. Form fields stay text; ``plans`` type them."""

from pyspark.sql.types import ArrayType, StringType, StructField, StructType

CASE_FIELDS = (
    "gravidadeMaxima",
    "tbIrregularidade___1",
    "irregularidade",
    "mddCorretSelecionada",
    "unidade",
    "solicitante",
    "prejFinanc",
    "cidadeFato",
    "regiaoUnidade",
    "nmInvestigado",
    "descFato",
    "conclusao",
)
PAYMENT_FIELDS = (
    "departamentoSolicitante",
    "empresaPagamento",
    "unidadeSolicitante",
    "nomeSolicitante",
    "tpPagamento",
    "aprovarSolic",
    "funcaoSolicitante",
    "observacao",
    "natureza",
    "codFornecedor",
    "vencimento",
    "numTitulo",
    "numPedido",
    "nomeRazaoSocial",
    "nomeFantasia",
    "cpfCnpj",
)

# A form field that is given but null counts as blank here; one that is not given stays null.
NULL_IS_BLANK = ("tbIrregularidade___1",)

ENVELOPE_FIELDS = ("processInstanceId", "processId", "status", "startDate", "endDate")


def _texts(names):
    return [StructField(name, StringType()) for name in names]


FORM_FIELD = StructType(_texts(("field", "value")))


def _record(names):
    return StructType(_texts(names) + [StructField("formFields", ArrayType(FORM_FIELD))])


REQUEST = _record(ENVELOPE_FIELDS + CASE_FIELDS)
PAYMENT = _record(ENVELOPE_FIELDS + ("slaStatus",) + PAYMENT_FIELDS)
ACTIVITY = StructType(
    _texts(("processInstanceId", "processId", "startDate", "endDate"))
    + [StructField("state", StructType(_texts(("stateName",))))]
)
