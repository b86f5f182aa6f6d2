"""Texts that results depend on. Order matters wherever a rule list is read from the top."""

# Process ids and states asked of the process service.
CASE_PROCESS = "ElaborarRelatoriodeSindicancia"
PAYMENT_PROCESS = "ARF-SolicitaçãodePagamentoAntecipado"
REQUESTED_STATUS = ("OPEN", "FINALIZED")

# Activity states kept, and the name of a missing one.
STATES = (
    "Início",
    "Classificar Irregularidade",
    "Levantar os Fatos",
    "Realizar Parecer Jurídico",
    "Realizar Parecer Técnico",
    "Definir Medida Corretiva",
    "Aprovar Desligamento",
    "Fim",
)
UNKNOWN_STATE = "Desconhecido"

# Status and SLA labels, keyed by the lowercased source text.
STATUS = (("open", "Aberto"), ("finalized", "Finalizado"))
SOURCE_SLA = (("on_time", "No Prazo"), ("overdue", "Em Atraso"))
OPEN, FINISHED = "Aberto", "Finalizado"
ON_TIME, LATE = "No Prazo", "Em Atraso"
APPROVED = "aprovado"

# Severities, matched on lowercased text.
LIGHT, MODERATE, GRAVE, SEVERITY_MISSING = "Leve", "Moderada", "Grave", "Não informado"
SEVERITIES = (LIGHT, MODERATE, GRAVE, SEVERITY_MISSING)
SEVERITY_RULES = (
    ("leve", LIGHT),
    ("moderada", MODERATE),
    ("média", MODERATE),
    ("moderado", MODERATE),
    ("grave", GRAVE),
)
SEVERITY_OTHER = "outra"

# Days allowed by severity; a light or moderate case has more when its irregularity is undefined.
SLA_DAYS_GRAVE = 10
SLA_DAYS_NAMED = 1
SLA_DAYS_UNDEFINED = 3

# Corrective measures.
MEASURE_RULES = (
    ("Suspensão", "Suspensão"),
    ("Orientação Disciplinar", "Orientação Disciplinar"),
    ("Advertência Escrita", "Advertência Escrita"),
    ("Desligamento (Justa Causa) - Desligamento (Justa Causa)", "Desligamento (Justa Causa)"),
)
MEASURE_MISSING = "Não informada"

# Units.
UNIT_RULES = (("CEEM Boa Vista - Manaus", "CEEM Boa Vista/Manaus"),)
UNIT_MISSING = "Não informada"

# Irregularity codes. The traffic suspension code contains the plain traffic code, so it comes first.
UNDEFINED = "Indefinido/Outra"
IRREGULARITY_RULES = (
    ("equivocosatividadesprocedimentos", "Equívocos em Atividades ou Procedimentos"),
    ("ausenciasnaojustificadas", "Ausências Não Justificadas"),
    ("equivocosdocumentosregistros", "Equívocos em Documentos ou Registros"),
    ("violacaonormasprocedimentos", "Violação de Normas ou Procedimentos"),
    ("falsificacaodocumentos", "Falsificação de Documentos"),
    ("recorrenciacondutasmoderadas", "Recorrência de Condutas Moderadas"),
    ("recorrenciacondutasleves", "Recorrência de Condutas Leves"),
    ("usoexcessivocelular", "Uso Excessivo de Celular"),
    ("infracaotransitosuspensaocnh", "Infração de Trânsito com Suspensão de CNH"),
    ("infracaotransito", "Infração de Trânsito"),
    ("abandonoemprego", "Abandono de Emprego"),
    ("violacaopoliticasgrave", "Violação Grave de Políticas"),
    ("assediomoralsexual", "Assédio Moral ou Sexual"),
    ("embriaguezdrogas", "Embriaguez ou Drogas"),
    ("desrespeitoseguranca", "Desrespeito às Regras de Segurança"),
    ("desidia", "Desídia"),
    ("usoimpropriorecursos", "Uso Impróprio de Recursos"),
    ("atrasosfrequentesinjustificados", "Atrasos Frequentes e Injustificados"),
    ("atrasosesporadicos", "Atrasos Esporádicos"),
    ("outra", UNDEFINED),
)

# Departments. Three texts hold the organisation's own name, which the caller passes in.
DEPARTMENT_RULES = (
    ("ENCOM COMERCIAL - CPO ENCOMENDAS", "Encomendas"),
    ("JI PARANA  {company} - ENCOMENDAS COMERCIAL - CPO ENCOMENDAS", "Encomendas"),
    ("ADMINISTRATIVO - DPTO PESSOAL", "Departamento Pessoal"),
    ("ADMINIST - DPTO PESSOAL", "Departamento Pessoal"),
    ("FINANCEIRO - TESOURARIA", "Financeiro"),
    ("FINANCEIRO - PLANEJAMENTO", "Financeiro"),
    ("JI PARANA {company} - FINANCEIRO - COMPRAS - FIN CORPORATIVO", "Financeiro"),
    ("ADM - ESCRITORIO FILIAL", "Escritório Filial"),
    ("CUIABA {company} - ADMINISTRATIVO - ESCR FILIAL", "Escritório Filial"),
    ("MANUTENCAO - TECN/OFICINA", "Manutenção"),
    ("ADMINIST - ADM ATIVOS", "Administração de Ativos"),
    ("ADMINISTRATIVO - GERENCIA", "Gerência Administrativa"),
    ("OPERAC - CPO OPER INTERNO", "Operações Internas"),
)
DEPARTMENT_MISSING = "não informado"

# Monthly multiplier of a frequency, keyed by its lowercased name; anything else counts once.
FREQUENCIES = (
    ("diário", 22.0),
    ("semanal", 4.0),
    ("mensal", 1.0),
    ("bimestral", 0.5),
    ("trimestral", 0.33),
    ("semestral", 0.167),
    ("anual", 0.083),
)
FREQUENCY_OTHER = 1.0

# Seasons with the prefix of their sheet columns, and the sheet's column names per unit.
HIGH, LOW = "Alta", "Baixa"
SEASONS = (HIGH, LOW)
SEASON_PREFIX = {HIGH: "AT", LOW: "BT"}
UNIT_MARK = "AT_FREQUÊNCIA "
AUTOMATION = "NÍVEL DE AUTOMAÇÃO"
HOURS_EACH = "Tempo (h)"
DEMAND = "Demanda_Total_Horas"
NO_AUTOMATION = "nan"
HOURS_PER_PERSON = 200
STAFF = "Colaboradores_Necessarios"
STAFF_LONG = ("Métrica", "Valor")

# Versions from the earliest on, their components and the words of the comparison.
VERSIONS = ("Anterior", "Nova", "Arquitetura")
# Names of the sheets in the workbook of versions.
VERSION_SHEETS = {
    "Anterior": "Cadeia de Valor_Anterior",
    "Nova": "Cadeia de Valor_Nova",
    "Arquitetura": "Cadeia de Valor_Arquitetura",
}
COMPONENTS = ("Processo", "Procedimento", "Atividade", "Tarefa")
COMPONENT_COUNTS = ("Qtd_Processos", "Qtd_Procedimentos", "Qtd_Atividades", "Qtd_Tarefas")
REQUIRED_COMPONENTS = ("Processo", "Procedimento", "Atividade")
KEPT, REMOVED, NEW = "Mantido", "Removido", "Novo"

# Cell texts that a spreadsheet reader takes as empty.
EMPTY_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Headings of the detail tables.
CASE_DETAIL = (
    ("processInstanceId", "ID Processo"),
    ("startDate", "Data Início"),
    ("endDate", "Data Fim"),
    ("lead_time", "Lead Time"),
    ("status", "Status"),
    ("slaStatus", "Status SLA"),
    ("cidadeFato", "Cidade"),
    ("unidade", "Unidade"),
    ("regiaoUnidade", "Região"),
    ("tbIrregularidade___1", "Irregularidade"),
    ("gravidadeMaxima", "Gravidade"),
    ("nmInvestigado", "Investigado"),
    ("solicitante", "Solicitante"),
    ("conclusao", "Conclusão"),
    ("prejFinanc", "Prejuízo Financeiro"),
)
PAYMENT_DETAIL = (
    ("processInstanceId", "ID Processo"),
    ("startDate", "Data Início"),
    ("endDate", "Data Fim"),
    ("natureza", "Natureza"),
    ("codFornecedor", "Código do Fornecedor"),
    ("vencimento", "Vencimento"),
    ("numTitulo", "Numero do Titulo"),
    ("numPedido", "Número do Pedido"),
    ("nomeRazaoSocial", "Nome/Razão Social"),
    ("nomeFantasia", "Nome Fantasia"),
    ("cpfCnpj", "CPF/CNPJ"),
    ("status", "Status"),
    ("slaStatus", "Status SLA"),
    ("unidadeSolicitante", "Unidade"),
    ("tpPagamento", "Tipo de Pagamento"),
    ("empresaPagamento", "Empresa de Pagamento"),
    ("departamentoSolicitante", "Departamento Solicitante"),
    ("lead_time", "Lead Time"),
    ("nomeSolicitante", "Nome do Solicitante"),
    ("funcaoSolicitante", "Função do Solicitante"),
    ("observacao", "Observação"),
)
