"""Inputs derived from the given tables.

The tables hold no Austrian identifiers, so letters and chat snippets are written from customer, order
and conversation keys.  The expressions are plain SQL that Spark and DuckDB read alike; only the
expressions are shared with the checks, never an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = "Thomas,Maria,Anna,Stefan,Julia,Markus,Petra,Karl"
LAST = "Gruber,Huber,Berger,Wagner,Moser"
ILLNESS = "Grippe,Migräne,Asthma,Diabetes"
CARDS = "4111 1111 1111 1111,5555 5555 5555 4444,4012-8888-8888-1881,5105105105105100"
IBANS = "DE89 3704 0044 0532 0130 00,FR14 2004 1010 0505 0001 3M02 606,DE89 3704 0044 0532 0130 01"


def pick(options: str, k: str) -> str:
    n = options.count(",") + 1
    return f"split_part('{options}', ',', cast(({k}) % {n} as int) + 1)"


def digits(k: str, width: int) -> str:
    return f"lpad(cast(({k}) as string), {width}, '0')"


def first_name(k: str) -> str:
    return pick(FIRST, k)


def uid(k: str) -> str:
    return f"concat('ATU', {digits(f'({k}) * 37 + 11', 8)})"


def iban(k: str) -> str:
    return (
        f"concat('AT', {digits(f'({k}) % 90 + 10', 2)}, ' 3200 ', {digits(f'({k}) % 9973', 4)}, ' ', "
        f"{digits(f'(({k}) * 7) % 9967', 4)}, ' 5678')"
    )


def ip(k: str) -> str:
    return (
        f"concat('10.', cast(({k}) % 200 as string), '.', cast((({k}) * 3) % 250 as string), '.', "
        f"cast((({k}) * 7) % 240 as string))"
    )


NL = "chr(10)"


def letter(k: str, name: str, day: str) -> str:
    """One letter; optional lines depend on the key."""
    h = f"md5(cast({k} as string))"
    lines = [
        f"'Grüße 😀 an Sie, sehr geehrter Herr ', {first_name(k)}, ' ', {pick(LAST, k)}, ',', {NL}",
        f"'Auftraggeber: ', {name}, {NL}",
        f"'UID: ', {uid(k)}, {NL}",
        f"'IBAN ', {iban(k)}, '; BIC GIBAATWW', {NL}",
        f"'Sozialversicherungsnummer: ', {digits(f'{k} % 9000 + 1000', 4)}, ' ', {digits(f'{k} % 28 + 1', 2)}, '0380', {NL}",
        f"'Firmenbuch FN ', {digits(f'{k} * 13 % 900000 + 100000', 6)}, 'a', {NL}",
        f"'Tel: +43 1 ', {digits(f'{k} * 31 % 9000000 + 1000000', 7)}, ' oder 0664/', {digits(f'{k} % 900000 + 100000', 6)}, '.', {NL}",
        f"'Passwort: geheim', cast({k} as string), {NL}",
        f"'Der Server hat die IP ', {ip(k)}, ', vom ', {day}, ' bis 24.12.2025.', {NL}",
        f"'Diagnose: ', {pick(ILLNESS, k)}, '. Gruß von ', {first_name(f'{k} + 3')}, ', der ', {first_name(f'{k} + 5')}, ' kennt.', {NL}",
        f"case when {k} % 2 = 0 then concat('E-Mail: kunde', cast({k} as string), '@mail.example.org', {NL}) else '' end",
        f"case when {k} % 3 = 0 then concat('mein Token ist tok', substr({h}, 1, 8), ' und sk-', substr({h}, 1, 24), {NL}) else '' end",
        f"case when {k} % 5 = 1 then concat('Authorization: Bearer eyJ', {h}, '.eyJ', {h}, '.', {h}, {NL}) else '' end",
        f"case when {k} % 5 = 2 then concat('postgres://app:pw@db.example.org/app', cast({k} as string), {NL}) else '' end",
        f"case when {k} % 7 = 3 then concat('-----BEGIN RSA PRIVATE KEY-----', {NL}, {h}, {NL}, '-----END RSA PRIVATE KEY-----', {NL}) else '' end",
        f"case when {k} % 4 = 1 then concat('Kreditkarte ', {pick(CARDS, k)}, ' und Kennzeichen W ', {digits(f'{k} % 90000 + 10000', 5)}, 'X.', {NL}) else '' end",
        f"case when {k} % 6 = 2 then concat('Konto ', {pick(IBANS, f'cast(floor({k} / 6) as bigint)')}, '.', {NL}) else '' end",
        f"case when {k} % 8 = 4 then concat('Religion: katholisch, Partei: gruene Liste. Gewerkschaft: GPA.', {NL}, 'Abstammung: kroatisch.', {NL}) else '' end",
        f"case when {k} % 9 = 5 then concat('Host 2001:0db8:85a3:0000:0000:8a2e:0370:', substr({h}, 1, 4), ' Reisepass P', {digits(f'{k} % 9000000 + 1000000', 7)}, {NL}) else '' end",
        f"case when {k} % 10 = 6 then concat('Projektleiter:  ', {first_name(f'{k} + 1')}, ' Holzer ', {NL}, 'Amex 3782-822463-10005 Steuernummer 12/345/67890', {NL}) else '' end",
        f"'Das Projekt Silberfuchs mit Partner Nordlicht Zentrale bleibt vertraulich.'",
    ]
    return "concat(" + ", ".join(lines) + ")"


LETTER = letter("c_custkey", "c_name", "substr(cast(coalesce(od, timestamp '2024-01-02 00:00:00') as string), 1, 10)")

LETTERS_SQL = f"""
letters as (
  select c_custkey as doc_id, {LETTER} as text
  from customer left join
       (select o_custkey, min(o_orderdate) as od from orders group by o_custkey) o on o_custkey = c_custkey
)"""

TEXTS_OFFSET = 1_000_000_000
TEXTS_SQL = (
    LETTERS_SQL
    + f""",
texts as (
  select doc_id, text from documents union all select doc_id + {TEXTS_OFFSET} as doc_id, text from letters
)"""
)

SNIPPET = (
    "concat(text, ' Bitte an Herr ', "
    + first_name("conv_id + turn")
    + ", ', IBAN ', "
    + iban("conv_id * 17 + turn % 3")
    + ", '; IP ', "
    + ip("conv_id + turn % 2")
    + ", ' und ', "
    + first_name("conv_id * 3 + turn * 5")
    + ", ' grüßt.')"
)
CHAT_SQL = f"chat as (select conv_id, turn, role, {SNIPPET} as text from conversations)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal the rows over the cores before a text-heavy stage.

    The number of splits does not tell: a file with one row group has as many as its size asks for, and all its rows come
    from one of them.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(tasks * 2, df.rdd.getNumPartitions()), *columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = (
        table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("od"))
    )
    customer = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    joined = customer.join(first, customer.c_custkey == first.o_custkey, "left")
    return joined.selectExpr("c_custkey as doc_id", f"{LETTER} as text")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and letters in one table."""
    own = letters(spark, sf_dir).withColumn("doc_id", F.col("doc_id") + TEXTS_OFFSET)
    return documents(spark, sf_dir).unionByName(own)


LETTERS_PER_FILE = 50


def letter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty letters joined into one long text, so the name pool has to wrap."""
    rows = letters(spark, sf_dir).withColumn("file", F.floor(F.col("doc_id") / LETTERS_PER_FILE))
    # A stated number of partitions keeps small outputs from being merged into one slow task.
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism * 2, 8), "file")
    return rows.groupBy(F.col("file").alias("doc_id")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda r: r["text"]), "\n"
        ).alias("text")
    )


LETTER_FILES_SQL = (
    LETTERS_SQL
    + f""",
letter_files as (
  select doc_id // {LETTERS_PER_FILE} as doc_id, string_agg(text, chr(10) order by doc_id) as text
  from letters group by 1
)"""
)


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", f"{SNIPPET} as text")
