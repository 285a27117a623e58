"""Domain packs: terms, patterns and phase texts of a business domain, and how well texts fit one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_accents


@dataclass(frozen=True)
class Pack:
    """What a domain calls its things. phases, steps: kind to label, objective, actors."""

    id: str
    label: str
    terms: tuple[str, ...] = ()
    systems: tuple[str, ...] = ()
    channels: tuple[str, ...] = ()
    terminal_patterns: tuple[str, ...] = ()
    handoff_patterns: tuple[str, ...] = ()
    phases: dict[str, tuple[str, str, tuple[str, ...]]] = field(default_factory=dict)
    steps: dict[str, tuple[str, str, tuple[str, ...]]] = field(default_factory=dict)


# Texts of phases and of the phases of steps, terms, systems, channels and patterns.
GENERIC = Pack(
    "generic",
    "Generic",
    phases={
        "intake": ("Recepcao operacional", "Receber o insumo inicial da funcionalidade.", ("Orquestrador tecnico",)),
        "validation": ("Validacao e elegibilidade", "Validar os dados e aplicar regras de elegibilidade.", ("Motor de regras",)),
        "handoff": ("Handoff e integracao", "Transferir o processamento entre plataformas ou componentes.", ("Servico externo",)),
        "persistence": ("Persistencia funcional", "Persistir o resultado funcional e o estado do fluxo.", ("Banco de dados",)),
        "output": ("Entrega e retorno", "Emitir o artefato final e disponibilizar o retorno.", ("Consumidor a jusante",)),
    },
    steps={
        "intake": ("Recepcao operacional", "Receber arquivos, parametros ou mensagens e preparar o processamento.", ("Orquestrador batch",)),
        "validation": ("Validacao e elegibilidade", "Validar dados, aplicar condicoes e direcionar o fluxo.", ("Motor de regras",)),
        "handoff": ("Handoff e integracao", "Transferir o fluxo entre plataformas e componentes.", ("Servico externo",)),
        "consolidation": ("Consolidacao e preparacao de saida", "Consolidar o resultado e preparar os artefatos seguintes.", ("Motor legado", "Banco de dados")),
        "persistence": ("Persistencia funcional", "Persistir o estado ou resultado parcial.", ("Banco de dados",)),
        "output": ("Entrega e retorno", "Gerar a saida consumida a jusante.", ("Consumidor a jusante",)),
        "processing": ("Processamento central", "Executar a regra central desta etapa.", ("Motor legado",)),
    },
)
CESSAO = Pack(
    "cessao-c3",
    "Cessao / CIP-C3 / VB6",
    terms=("TERMO", "CESSAO", "CEDENTE", "CESSIONARIO", "ASSINAT", "ASSINA", "CNAB600", "CNAB400", "CIP", "C3", "ISD", "ACCC013", "ACCC014", "ACCC031", "ACCC032", "SBAT8000", "SBAT8500", "REMESSA", "RETORNO", "TTERMO", "TMOD"),
    systems=("ISD", "CIP", "C3", "ACCC013", "ACCC014", "ACCC031", "ACCC032", "SBAT8000", "SBAT8500"),
    channels=("CNAB600", "CNAB400", "ISD", "ARQUIVO", "REMESSA", "RETORNO"),
    terminal_patterns=(
        r"(?i)\b(PR_|SP_|FC_).*(TERMO|CSSAO|CESSAO|ASSIN|REMESSA|RETORNO)\b",
        r"(?i)\b(TMOD|TTERMO|TERMO|CSSAO|CESSAO).*(ASSIN|FINAL|RETORNO)\b",
        r"(?i)\b(TERMO|CESSAO).*(ASSIN|RETORNO|PROTOCOLO|FINAL)\b",
        r"(?i)\b(CIP|C3|ISD)\b",
    ),
    handoff_patterns=(r"(?i)\b(ISD|CIP|C3|VB6|DESKTOP|CNAB600|CNAB400|REMESSA|RETORNO)\b",),
    phases={
        "intake": ("Recepcao da cessao", "Receber arquivo, mensagem ou lote inicial da cessao.", ("Mainframe batch",)),
        "validation": ("Elegibilidade e validacao da cessao", "Validar os titulos e aplicar regras de elegibilidade da cessao.", ("Mainframe batch", "Motor de regras")),
        "handoff": ("Transferencia para desktop e integracoes", "Transferir o fluxo do mainframe para desktop, servicos e integracoes externas.", ("Mainframe batch", "ISD", "VB6", "Operador desktop")),
        "persistence": ("Formalizacao e persistencia do termo", "Formalizar o termo, persistir estados e registrar a assinatura.", ("VB6", "SQL Server", "Assinador")),
        "output": ("Retorno e consolidacao da cessao", "Emitir o retorno, consolidar o resultado e fechar a jornada do termo.", ("SQL Server", "CIP/C3")),
    },
    steps={
        "intake": ("Recepcao da cessao", "Receber arquivo, mensagem ou lote inicial da cessao.", ("Mainframe batch",)),
        "validation": ("Elegibilidade e validacao da cessao", "Validar os titulos e aplicar regras de elegibilidade da cessao.", ("Motor de regras",)),
        "handoff": ("Transferencia para desktop e integracoes", "Transferir o fluxo do mainframe para desktop, servicos e integracoes externas.", ("Mainframe batch", "ISD", "VB6", "Operador desktop")),
        "consolidation": ("Formalizacao e persistencia do termo", "Formalizar o termo, persistir estados e registrar a assinatura.", ("VB6", "SQL Server", "Assinador")),
        "persistence": ("Formalizacao e persistencia do termo", "Formalizar o termo, persistir estados e registrar a assinatura.", ("VB6", "SQL Server", "Assinador")),
        "output": ("Retorno e consolidacao da cessao", "Emitir o retorno, consolidar o resultado e fechar a jornada do termo.", ("SQL Server", "CIP/C3")),
        "processing": ("Processamento central", "Executar a regra central desta etapa.", ("Motor legado",)),
    },
)
PACKS = {p.id: p for p in (GENERIC, CESSAO)}
# What a pattern, a word of an end and a term add, the words of an end, and terms from which a pack is taken.
TERMINAL_EACH, TERMINAL_WORD, HANDOFF_EACH, TERM_EACH, MOST, LEAST_TERMS = 28, 12, 24, 18, 100, 3
TERMINAL_WORDS = r"(?i)(ASSIN|FINAL|RETORNO|PROTOCOLO|TERMO)"


def upper_plain(c: Column) -> Column:
    return F.upper(fold_accents(F.coalesce(c, F.lit(""))))


def matches(c: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns match."""
    hits = F.lit(0)
    for p in patterns:
        hits = hits + F.coalesce(c.rlike(p), F.lit(False)).cast("int")
    return hits


def terminal_score(c: Column, pack: Pack) -> Column:
    """28 for each pattern of an end, and 12 for a word of an end, up to 100."""
    return F.least(F.lit(MOST), matches(c, pack.terminal_patterns) * TERMINAL_EACH + matches(c, (TERMINAL_WORDS,)) * TERMINAL_WORD)


def handoff_score(c: Column, pack: Pack) -> Column:
    return F.least(F.lit(MOST), matches(c, pack.handoff_patterns) * HANDOFF_EACH)


def term_flags(c: Column, pack: Pack) -> list[Column]:
    """For each term of the pack, whether the text holds it; terms do not span two values."""
    text = upper_plain(c)
    return [F.contains(text, F.lit(t)) for t in pack.terms]


def terms_met(values: DataFrame, pack: Pack, by: list[str] = [], value: str = "value") -> DataFrame:  # noqa: B006
    """(by, n_terms): how many terms of the pack occur in the values of a group; one pass over the values for all terms."""
    flags = term_flags(F.col(value), pack)
    if not flags:
        return values.groupBy(*by).agg(F.lit(0).alias("n_terms"))
    met = values.groupBy(*by).agg(*[F.max(f.cast("int")).alias(f"__t{k}") for k, f in enumerate(flags)])
    total = F.lit(0)
    for k in range(len(flags)):
        total = total + F.coalesce(f"__t{k}", F.lit(0))
    return met.select(*by, total.alias("n_terms"))


def chosen(values: DataFrame, requested: str = "auto") -> Pack:
    """The pack that is asked for; without a wish the special one if at least three of its terms occur anywhere in values (value)."""
    if requested.lower() != "auto":
        return PACKS.get(requested.lower(), GENERIC)
    for pack in PACKS.values():
        if pack.terms and terms_met(values, pack).first()["n_terms"] >= LEAST_TERMS:
            return pack
    return GENERIC
