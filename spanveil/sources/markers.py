"""Templates of gold texts: ``{LABEL|text}``, ``{LABEL?|text}`` for an optional span, ``{LABEL#hard|text}`` for a hard one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.text import located

MARKER = r"\{[A-Z_]+\??(?:#hard)?\|[^}]*\}"
_PARTS = r"\{([A-Z_]+)(\??)(?:#(hard))?\|([^}]*)\}"
# Gold labels and their groups.
GROUPS = {
    "PATIENT_NAME": "NAME", "DOCTOR_NAME": "NAME", "OTHER_NAME": "NAME",
    "CPF": "DOC_NUM", "RG": "DOC_NUM", "CNS": "DOC_NUM", "CNES": "DOC_NUM", "CRM": "DOC_NUM", "COREN": "DOC_NUM", "RQE": "DOC_NUM", "PRONTUARIO": "DOC_NUM",
    "ATENDIMENTO": "DOC_NUM", "CARTEIRINHA": "DOC_NUM", "GUIA_NUM": "DOC_NUM", "SENHA_AUT": "DOC_NUM", "NUMERO": "DOC_NUM",
    "PHONE": "CONTACT", "EMAIL": "CONTACT", "ADDRESS": "LOCATION", "CEP": "LOCATION", "DATE": "DATE", "DATE_OF_BIRTH": "DATE", "AGE": "AGE", "CNPJ": "ORG", "INSTITUTION": "ORG",
}


def clean(template: Column) -> Column:
    """The text of a template without its markers."""
    return F.regexp_replace(template, _PARTS, "$4")


def gold_spans(template: Column) -> Column:
    """Spans of the clean text: start, end, label, group, txt, optional, difficulty; an unknown label is an error."""
    groups = F.create_map(*[x for k, v in GROUPS.items() for x in (F.lit(k), F.lit(v))])
    part = lambda m, i: F.regexp_extract(m["txt"], _PARTS, i)
    label = lambda m: part(m, 1)
    group = lambda m: F.coalesce(F.try_element_at(groups, label(m)), F.raise_error(F.concat(F.lit("unknown gold label "), label(m))).cast("string"))
    found = located(template, MARKER, F.regexp_extract_all(template, F.lit(MARKER), F.lit(0)))
    # each marker before makes the clean text shorter by what stands around its value
    step = lambda acc, m: F.struct(
        (acc["less"] + F.length(m["txt"]) - F.length(part(m, 4))).cast("int").alias("less"),
        F.concat(
            acc["out"],
            F.array(
                F.struct(
                    (m["start"] - acc["less"]).alias("start"), (m["start"] - acc["less"] + F.length(part(m, 4))).alias("end"), label(m).alias("label"), group(m).alias("group"), part(m, 4).alias("txt"),
                    (part(m, 2) == "?").alias("optional"), F.when(part(m, 3) == "hard", "hard").otherwise("normal").alias("difficulty"),
                )
            ),
        ).alias("out"),
    )
    kind = "array<struct<start:int,end:int,label:string,group:string,txt:string,optional:boolean,difficulty:string>>"
    return F.aggregate(found, F.struct(F.lit(0).alias("less"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])
