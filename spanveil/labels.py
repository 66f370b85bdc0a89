"""Label dictionaries and their Column forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A model's labels and what they become.
REMAP = {
    "SSN": "BR_DOC", "TAXNUM": "BR_DOC", "TAXID": "BR_DOC", "GOVID": "BR_DOC",
    "FIRSTNAME": "PERSON", "LASTNAME": "PERSON", "MIDDLENAME": "PERSON", "FULLNAME": "PERSON", "USERNAME": "PERSON",
    "PHONENUMBER": "PHONE", "PHONE_NUMBER": "PHONE", "PHONEIMEI": "PHONE",
    "EMAILADDRESS": "EMAIL", "EMAIL_ADDRESS": "EMAIL",
    "STREET": "ADDRESS", "STREETADDRESS": "ADDRESS", "BUILDINGNUMBER": "ADDRESS", "SECONDARYADDRESS": "ADDRESS", "COUNTY": "CITY",
    "DATEOFBIRTH": "DATE_OF_BIRTH", "DOB": "DATE_OF_BIRTH",
    "ACCOUNTNUMBER": "ID", "ACCOUNTNAME": "ID", "CREDITCARDNUMBER": "ID", "CREDITCARD": "ID", "BANKACCOUNT": "ID", "USERAGENT": "ID",
    "URL": "URL", "IP": "IP", "IPV4": "IP", "IPV6": "IP",
    "PREFIX": "DROP", "SUFFIX": "DROP", "TITLE": "DROP", "JOBTITLE": "DROP", "JOBAREA": "DROP", "JOBTYPE": "DROP",
    "AMOUNT": "DROP", "AMOUNTOFMONEY": "DROP", "MONEY": "DROP", "CURRENCY": "DROP", "CURRENCYCODE": "DROP", "CURRENCYNAME": "DROP", "CURRENCYSYMBOL": "DROP",
    "MEASUREMENT": "DROP", "PERCENT": "DROP", "PERCENTAGE": "DROP", "QUANTITY": "DROP", "TIME": "DROP", "ORDINAL": "DROP",
    "CARDINAL": "NUM_CANDIDATE", "NUMBER": "NUM_CANDIDATE",
    "COMPANY_NAME": "INSTITUTION", "COMPANYNAME": "INSTITUTION", "ORDINALDIRECTION": "DROP",
    "MASKEDNUMBER": "ID", "PIN": "ID", "BIC": "ID", "IBAN": "ID", "VEHICLEVRM": "ID", "VEHICLEVIN": "ID",
    "BITCOINADDRESS": "ID", "ETHEREUMADDRESS": "ID", "LITECOINADDRESS": "ID",
}

# What stands in a redacted text.
PLACEHOLDER = {
    "BR_DOC": "[DOC]", "BR_CPF": "[CPF]", "CPF": "[CPF]", "BR_CNPJ": "[CNPJ]", "CNPJ": "[CNPJ]", "BR_RG": "[RG]", "RG": "[RG]",
    "PERSON": "[NOME]", "PATIENT": "[NOME]", "PATIENT_NAME": "[NOME]",
    "DOCTOR": "[MÉDICO]", "DOCTOR_NAME": "[MÉDICO]", "PROFESSIONAL": "[PROFISSIONAL]",
    "DATE": "[DATA]", "DATE_OF_BIRTH": "[DATA_NASC]", "DOB": "[DATA_NASC]", "AGE": "[IDADE]",
    "PHONE": "[TELEFONE]", "PHONE_NUMBER": "[TELEFONE]", "EMAIL": "[EMAIL]",
    "ADDRESS": "[ENDEREÇO]", "STREET_ADDRESS": "[ENDEREÇO]", "CITY": "[CIDADE]", "STATE": "[UF]",
    "ZIP": "[CEP]", "ZIPCODE": "[CEP]", "POSTAL_CODE": "[CEP]", "ID": "[ID]",
    "MEDICAL_RECORD": "[PRONTUÁRIO]", "MEDICAL_RECORD_NUMBER": "[PRONTUÁRIO]", "MRN": "[PRONTUÁRIO]",
    "CRM": "[CRM]", "CNS": "[CNS]", "CNES": "[CNES]", "RQE": "[RQE]", "COREN": "[COREN]",
    "TISS_GUIDE": "[GUIA]", "TISS_AUTH": "[SENHA]", "INSURANCE_ID": "[CARTEIRINHA]", "NUMERO": "[NÚMERO]",
    "INSTITUTION": "[INSTITUIÇÃO]", "HOSPITAL": "[INSTITUIÇÃO]", "ORGANIZATION": "[INSTITUIÇÃO]", "URL": "[URL]", "IP": "[IP]",
}
DEFAULT_PLACEHOLDER = "[REDACTED]"

# Colours of the families of labels.
FAMILIES = {
    "patient": ("#db2777", ("PERSON", "PATIENT", "PATIENT_NAME")),
    "professional": ("#be185d", ("DOCTOR", "DOCTOR_NAME", "PROFESSIONAL")),
    "document": ("#ea580c", ("BR_DOC", "BR_CPF", "CPF", "BR_CNPJ", "CNPJ", "BR_RG", "RG", "CNS")),
    "record": ("#4f46e5", ("ID", "MEDICAL_RECORD", "MEDICAL_RECORD_NUMBER", "MRN")),
    "contact": ("#16a34a", ("PHONE", "PHONE_NUMBER", "EMAIL")),
    "address": ("#7c3aed", ("ADDRESS", "STREET_ADDRESS", "CITY", "STATE", "ZIP", "ZIPCODE", "POSTAL_CODE")),
    "time": ("#2563eb", ("DATE", "DATE_OF_BIRTH", "DOB", "AGE")),
    "council": ("#0d9488", ("CRM", "RQE", "COREN")),
    "institution": ("#475569", ("CNES", "INSTITUTION", "HOSPITAL", "ORGANIZATION")),
    "insurance": ("#a16207", ("TISS_GUIDE", "TISS_AUTH", "INSURANCE_ID")),
    "network": ("#0369a1", ("URL", "IP")),
    "suspect": ("#78716c", ("NUMERO",)),
    "manual": ("#f59e0b", ("MANUAL",)),
    "other": ("#c026d3", ()),
}
COLOUR = {label: colour for colour, labels in FAMILIES.values() for label in labels}
DEFAULT_COLOUR = FAMILIES["other"][0]

PERSON_LABELS = ("PERSON", "PATIENT", "PATIENT_NAME", "DOCTOR", "DOCTOR_NAME")

# Priorities of the rule labels; all others have the default.
PRIORITY = {"BR_CNPJ": 100, "BR_CPF": 95, "EMAIL": 80, "PHONE": 78, "CRM": 75, "ZIPCODE": 50, "DATE": 48, "AGE": 40, "BR_RG": 45, "DIGIT_RUN": 10}
DEFAULT_PRIORITY = 55


def lookup(table: dict, key: Column, default) -> Column:
    """The table's value for the key, or the default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default) if not isinstance(default, Column) else default)


def remap(label: Column) -> Column:
    return lookup(REMAP, label, label)


def placeholder(label: Column) -> Column:
    return lookup(PLACEHOLDER, F.upper(label), DEFAULT_PLACEHOLDER)


def colour(label: Column) -> Column:
    return lookup(COLOUR, F.upper(label), DEFAULT_COLOUR)


def priority(label: Column) -> Column:
    return lookup(PRIORITY, label, DEFAULT_PRIORITY)


def dimension(spark: SparkSession) -> DataFrame:
    """label, colour, placeholder of every label that has a placeholder."""
    rows = [(label, COLOUR.get(label, DEFAULT_COLOUR), text) for label, text in PLACEHOLDER.items()]
    return spark.createDataFrame(rows, "label string, colour string, placeholder string")
