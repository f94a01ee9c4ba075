"""Readers of disclosure-shaped inputs. Rows that cannot be used stay, with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, temporal
from ..functions.checks import require

#: The ownership document as far as it is read.
OWNERSHIP = """documentType STRING, issuer STRUCT<issuerCik STRING, issuerName STRING, issuerTradingSymbol STRING>,
 reportingOwner ARRAY<STRUCT<reportingOwnerId STRUCT<rptOwnerCik STRING, rptOwnerName STRING>,
   reportingOwnerRelationship STRUCT<isDirector STRING, isOfficer STRING, isTenPercentOwner STRING, isOther STRING, officerTitle STRING>>>,
 footnotes STRUCT<footnote ARRAY<STRUCT<_VALUE STRING, _id STRING>>>,
 nonDerivativeTable STRUCT<nonDerivativeTransaction ARRAY<STRUCT<securityTitle STRUCT<value STRING>, transactionDate STRUCT<value STRING>,
   transactionCoding STRUCT<transactionFormType STRING, transactionCode STRING>,
   transactionAmounts STRUCT<transactionShares STRUCT<value STRING>, transactionPricePerShare STRUCT<value STRING>, transactionAcquiredDisposedCode STRUCT<value STRING>>>>,
   nonDerivativeHolding ARRAY<STRUCT<securityTitle STRUCT<value STRING>>>>,
 derivativeTable STRUCT<derivativeTransaction ARRAY<STRUCT<securityTitle STRUCT<value STRING>, transactionDate STRUCT<value STRING>, transactionCoding STRUCT<transactionFormType STRING, transactionCode STRING>>>,
   derivativeHolding ARRAY<STRUCT<securityTitle STRUCT<value STRING>>>>"""

#: Elements that one parent has at most once: two of them could share out their children and still be read as one.
SINGLE = {"ownershipDocument": ("documentType", "issuer", "nonDerivativeTable", "derivativeTable", "footnotes"), "issuer": ("issuerCik", "issuerName", "issuerTradingSymbol"), "reportingOwner": ("reportingOwnerId", "reportingOwnerRelationship"), "nonDerivativeTransaction": ("securityTitle", "transactionDate", "transactionCoding", "transactionAmounts"), "transactionAmounts": ("transactionShares", "transactionPricePerShare", "transactionAcquiredDisposedCode"), "transactionCoding": ("transactionFormType", "transactionCode")}


def repeated_element(body: Column) -> Column:
    """Whether an element of a document that its parent may have once is there twice."""
    twice = [F.xpath_boolean(body, F.lit(f"//{parent}[count({child}) > 1]")) for parent, children in SINGLE.items() for child in children]
    return F.greatest(*(t.cast("int") for t in twice)) == 1


def header(text: Column, key: str) -> Column:
    """The value of a header line, null unless there is exactly one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?m)^\s*{key}:\s*(.+?)\s*$"), F.lit(1))
    return F.when(F.size(found) == 1, found[0])


def exclusion(form: Column, kind: Column, code: Column, form_type: Column, day: Column) -> Column:
    """Why a row of an ownership table is not a usable open-market transaction; null if it is. The first reason counts."""
    return (
        F.when(~form.isin("4", "4/A"), "unsupported_form")
        .when(kind == "derivative", "derivative_table")
        .when(kind == "holding", "non_transaction_holding")
        .when(~F.coalesce(code.isin("P", "S"), F.lit(False)), "unsupported_code")
        .when(~F.coalesce(form_type.isin("4", "4/A"), F.lit(False)), "unsupported_transaction_form")
        .when(day.isNull(), "missing_transaction_date")
    )


def ownership(submissions: DataFrame) -> DataFrame:
    """A row for each table row of (path, text) submissions, with header values, position, amounts and exclusion.

    Submissions with a DTD or entities, without exactly one document, with a repeated element, of over 5 MB,
    with an invalid flag, or whose header and document disagree on the form, give one row with ``defect``.
    """
    body = F.regexp_extract_all("text", F.lit(r"(?s)(<ownershipDocument>.*?</ownershipDocument>)"), F.lit(1))
    docs = submissions.select("path", header(F.col("text"), "ACCESSION NUMBER").alias("accession"), header(F.col("text"), "CONFORMED SUBMISSION TYPE").alias("form"), header(F.col("text"), "FILED AS OF DATE").alias("filed"), temporal.local_to_utc(F.regexp_extract("text", r"<ACCEPTANCE-DATETIME>([0-9]{14})", 1)).alias("accepted_utc"), body.alias("body"), F.col("text").rlike(r"(?i)<!\s*(DOCTYPE|ENTITY)").alias("unsafe"), (F.octet_length("text") > 5_000_000).alias("too_long"))
    docs = docs.withColumn("doc", F.when(~F.col("unsafe") & (F.size("body") == 1), F.from_xml(F.col("body")[0], OWNERSHIP)))
    flags = F.flatten(F.transform(F.coalesce("doc.reportingOwner", F.array()), lambda o: F.array(*(o["reportingOwnerRelationship"][k] for k in ("isDirector", "isOfficer", "isTenPercentOwner", "isOther")))))
    odd_flag = F.exists(flags, lambda x: F.coalesce(~F.trim(x).isin("", "0", "1", "true", "false"), F.lit(False)))
    side = F.transform(F.coalesce("doc.nonDerivativeTable.nonDerivativeTransaction", F.array()), lambda x: F.concat_ws("", x["transactionCoding"]["transactionCode"], x["transactionAmounts"]["transactionAcquiredDisposedCode"]["value"]))
    twice = F.when(~F.col("unsafe") & (F.size("body") == 1), repeated_element(F.col("body")[0]))
    defect = F.when(F.col("unsafe"), "dtd_or_entity").when(F.col("too_long"), "too_long").when(F.size("body") != 1, "not_one_document").when(twice, "repeated_element").when(odd_flag, "invalid_owner_flag").when(F.exists(side, lambda x: x.isin("PD", "SA")), "code_contradicts_side").when(F.col("doc.documentType").isNull(), "unreadable_document").when(F.col("form").isNotNull() & (F.col("form") != F.col("doc.documentType")), "form_disagrees")
    docs = docs.withColumn("defect", defect)
    one = lambda kind, day, code, form_type, shares, price, side: F.struct(F.lit(kind).alias("kind"), day.alias("day"), code.alias("code"), form_type.alias("form_type"), shares.alias("shares"), price.alias("price"), side.alias("side"))
    none = F.lit(None).cast("string")
    trades = F.transform(F.coalesce("doc.nonDerivativeTable.nonDerivativeTransaction", F.array()), lambda x: one("transaction", x["transactionDate"]["value"], x["transactionCoding"]["transactionCode"], x["transactionCoding"]["transactionFormType"], x["transactionAmounts"]["transactionShares"]["value"], x["transactionAmounts"]["transactionPricePerShare"]["value"], x["transactionAmounts"]["transactionAcquiredDisposedCode"]["value"]))
    held = F.transform(F.coalesce("doc.nonDerivativeTable.nonDerivativeHolding", F.array()), lambda x: one("holding", none, none, none, none, none, none))
    derived = F.transform(F.coalesce("doc.derivativeTable.derivativeTransaction", F.array()), lambda x: one("derivative", x["transactionDate"]["value"], x["transactionCoding"]["transactionCode"], x["transactionCoding"]["transactionFormType"], none, none, none))
    options = F.transform(F.coalesce("doc.derivativeTable.derivativeHolding", F.array()), lambda x: one("derivative", none, none, none, none, none, none))
    yes = lambda x: F.when(F.trim(x).isin("1", "true"), True).when(F.trim(x).isin("0", "false"), False)
    roles = F.transform("doc.reportingOwner", lambda o: F.struct(o["reportingOwnerId"]["rptOwnerCik"].alias("cik"), o["reportingOwnerId"]["rptOwnerName"].alias("name"), yes(o["reportingOwnerRelationship"]["isDirector"]).alias("director"), yes(o["reportingOwnerRelationship"]["isOfficer"]).alias("officer"), yes(o["reportingOwnerRelationship"]["isTenPercentOwner"]).alias("ten_percent_owner"), yes(o["reportingOwnerRelationship"]["isOther"]).alias("other"), o["reportingOwnerRelationship"]["officerTitle"].alias("officer_title")))
    notes = F.map_from_entries(F.transform(F.coalesce("doc.footnotes.footnote", F.array()), lambda n: F.struct(n["_id"], n["_VALUE"])))
    rows = docs.select("path", "accession", "form", "filed", "accepted_utc", "defect", F.col("doc.issuer.issuerCik").alias("issuer"), F.col("doc.issuer.issuerName").alias("issuer_name"), F.transform("doc.reportingOwner", lambda o: o["reportingOwnerId"]["rptOwnerCik"]).alias("owners"), roles.alias("owner_roles"), notes.alias("footnotes"), F.posexplode_outer(F.concat(trades, held, derived, options)).alias("row_index", "r"))
    day = F.col("r.day").try_cast("date")
    why = F.when(F.col("defect").isNull() & F.col("r").isNotNull(), exclusion(F.coalesce("form", F.lit("4")), F.col("r.kind"), F.col("r.code"), F.col("r.form_type"), day))
    return rows.select("path", "accession", "form", "filed", "accepted_utc", "issuer", "issuer_name", "owners", "owner_roles", "footnotes", "row_index", F.col("r.kind").alias("kind"), F.col("r.code").alias("code"), F.col("r.side").alias("side"), day.alias("transaction_date"), parse.decimal(F.col("r.shares")).alias("shares"), parse.decimal(F.col("r.price")).alias("price"), "defect", why.alias("exclusion"))


def vendor_rows(bodies: DataFrame, allowed: tuple[str, ...], limit: int = 1_000_000) -> DataFrame:
    """Rows of (path, body) JSON arrays: allowed fields as a map, all others in ``quarantined`` JSON; positions are coordinates.

    A body that is no JSON array of objects, repeats a field or has over ``limit`` rows gives one row with ``body_defect``.
    """
    kind = F.schema_of_variant(parse.strict_json(F.col("body")))
    count = F.size(F.from_json("body", "array<map<string,string>>"))
    defect = F.when(parse.strict_json(F.col("body")).isNull(), "not_strict_json").when(~kind.startswith("ARRAY<OBJECT") & (kind != "ARRAY<VOID>"), "not_an_array_of_objects").when(count > limit, "too_many_rows")
    held = bodies.withColumn("body_defect", defect)
    rows = held.select("path", "body_defect", F.posexplode_outer(F.when(F.col("body_defect").isNull(), F.from_json("body", "array<map<string,string>>"))).alias("row_index", "fields")).filter("body_defect IS NOT NULL OR row_index IS NOT NULL")
    ok = F.array(*map(F.lit, allowed))
    return rows.select("path", "row_index", F.map_filter("fields", lambda k, v: F.array_contains(ok, k)).alias("facts"), F.to_json(F.map_filter("fields", lambda k, v: ~F.array_contains(ok, k))).alias("quarantined"), "body_defect")


def transaction_kind(raw: Column) -> Column:
    """Event type of a vendor's transaction word, whatever its case; null for any other."""
    kinds = F.create_map(*(F.lit(x) for pair in {"purchase": "equity_purchase", "sale": "equity_sale", "sale (full)": "equity_sale", "sale (partial)": "equity_sale"}.items() for x in pair))
    return F.element_at(kinds, F.lower(F.trim(raw)))


def relationships(bodies: DataFrame, categories: dict[int, str]) -> DataFrame:
    """Relationship resources of (path, body) JSON:API documents with both endpoints looked up; null and a reason where missing."""
    attrs = "struct<name string, entity1_id bigint, entity2_id bigint, category_id int, start_date string, end_date string, is_current boolean, updated_at string>"
    item = f"struct<type string, id string, attributes {attrs}>"
    docs = bodies.select("path", F.from_json("body", f"struct<meta struct<license string, apiVersion string>, data array<{item}>, included array<{item}>>").alias("j"))
    all_ = docs.select("path", F.explode(F.concat(F.coalesce("j.data", F.array()), F.coalesce("j.included", F.array()))).alias("x")).select("path", "x.type", "x.id", "x.attributes.*").distinct()
    edges, nodes = all_.filter("type = 'relationships'"), all_.filter("type = 'entities'").select("path", F.col("id").cast("bigint").alias("node"), F.col("name").alias("node_name"))
    for side in (1, 2):
        n = nodes.select(F.col("path").alias("p"), F.col("node").alias("n"), F.col("node_name").alias(f"name{side}"))
        edges = edges.join(n, (edges.path == n.p) & (edges[f"entity{side}_id"] == n.n), "left").drop("p", "n")
    kinds = F.create_map(*(x for k, v in categories.items() for x in (F.lit(k), F.lit(v))))
    kind = F.element_at(kinds, F.col("category_id"))
    reason = F.when(kind.isNull(), "unsupported_category").when(F.col("name1").isNull() | F.col("name2").isNull(), "unresolved_endpoint")
    semantic = F.sha2(F.to_json(F.struct("id", "category_id", "entity1_id", "entity2_id", "start_date", "end_date", "is_current"), {"ignoreNullFields": "false"}), 256)
    return edges.select("path", "id", semantic.alias("semantic_hash"), kind.alias("category"), "entity1_id", "entity2_id", temporal.partial_date(F.col("start_date")).alias("start"), temporal.partial_date(F.col("end_date")).alias("end"), reason.alias("reason"))


def graph_nodes(bodies: DataFrame) -> DataFrame:
    """(path, node, node_name, primary_type) of the entities of (path, body) JSON:API documents."""
    item = "struct<type string, id string, attributes struct<name string, primary_ext string>>"
    docs = bodies.select("path", F.from_json("body", f"struct<data array<{item}>, included array<{item}>>").alias("j"))
    rows = docs.select("path", F.explode(F.concat(F.coalesce("j.data", F.array()), F.coalesce("j.included", F.array()))).alias("x")).filter("x.type = 'entities'")
    return rows.select("path", F.col("x.id").try_cast("bigint").alias("node"), F.col("x.attributes.name").alias("node_name"), F.col("x.attributes.primary_ext").alias("primary_type")).distinct()


def graph_defects(bodies: DataFrame, license_url: str) -> DataFrame:
    """(path, defect) of graph documents that can't be used: not strict JSON, without the license, of another version, or with one resource twice and different."""
    meta = F.from_json("body", "struct<meta struct<license string, apiVersion string, copyright string>, errors string>")
    defect = F.when(parse.strict_json(F.col("body")).isNull(), "not_strict_json").when(meta["errors"].isNotNull(), "source_error").when(~meta["meta"]["license"].eqNullSafe(F.lit(license_url)), "other_license").when(~meta["meta"]["apiVersion"].eqNullSafe(F.lit("2.0")), "other_version").when(F.trim(F.coalesce(meta["meta"]["copyright"], F.lit(""))) == "", "no_copyright")
    plain = bodies.select("path", defect.alias("defect")).filter("defect IS NOT NULL")
    twice = relationships(bodies, {}).groupBy("path", "id").agg(F.count_distinct("semantic_hash").alias("n")).filter("n > 1").select("path", F.lit("conflicting_duplicate_resource")).distinct()
    return plain.union(twice)


def daily_index(lines: DataFrame, day: str) -> DataFrame:
    """Rows of a pipe-separated daily index of (path, value) lines: sound rows with their parts, others with a reason."""
    cut = F.split("value", r"\|")
    body = lines.filter(F.col("value").contains("|") & ~F.col("value").startswith("CIK|"))
    rows = body.select("path", F.when(F.size(cut) != 5, "not_five_fields").alias("malformed"), F.try_element_at(cut, F.lit(1)).alias("cik"), F.try_element_at(cut, F.lit(2)).alias("company"), F.try_element_at(cut, F.lit(3)).alias("form"), F.try_element_at(cut, F.lit(4)).alias("filed"), F.try_element_at(cut, F.lit(5)).alias("file_name"))
    accession = F.regexp_extract("file_name", r"^edgar/data/([0-9]+)/([0-9]{10}-[0-9]{2}-[0-9]{6})\.txt$", 2)
    owner = F.regexp_extract("file_name", r"^edgar/data/([0-9]+)/", 1)
    reason = F.when(F.col("malformed").isNotNull(), F.col("malformed")).when(~F.col("cik").rlike("^[0-9]{1,10}$"), "bad_cik").when(F.regexp_replace("filed", "-", "") != day.replace("-", ""), "other_day").when(accession == "", "bad_path").when(owner.try_cast("bigint") != F.col("cik").try_cast("bigint"), "path_disagrees")
    return rows.select(*rows.columns[:1], *rows.columns[2:], F.nullif(accession, F.lit("")).alias("accession"), reason.alias("reason"))


def index_defects(lines: DataFrame, day: str) -> DataFrame:
    """(path, defect) of daily indexes whose header names another day, or that have not exactly one line of columns."""
    stated = F.to_date(F.regexp_extract("value", r"^Date(?: of data)?:\s*(.+?)\s*$", 1).try_cast("date"))
    found = lines.groupBy("path").agg(F.max(F.coalesce(stated, F.to_date(F.try_to_timestamp(F.regexp_extract("value", r"^Date(?: of data)?:\s*(.+?)\s*$", 1), F.lit("MMM dd, yyyy"))))).alias("stated"), F.count_if(F.col("value").startswith("CIK|")).alias("columns"))
    defect = F.when(F.col("columns") != 1, "not_one_line_of_columns").when(F.col("stated") != F.to_date(F.lit(day)), "header_names_another_day")
    return found.select("path", defect.alias("defect")).filter("defect IS NOT NULL")


def reference_groups(rows: DataFrame) -> DataFrame:
    """Index rows by accession: forms, dates, distinct rows, exact repeats, whether they conflict, and the proposed locator."""
    whole = F.struct("cik", "company", "form", "filed", "file_name")
    grouped = rows.groupBy("accession").agg(F.array_sort(F.collect_set("form")).alias("forms"), F.array_sort(F.collect_set("filed")).alias("days"), F.count("*").alias("rows"), F.count_distinct(whole).alias("literals"), F.min(F.struct(F.col("cik").cast("bigint").alias("cik"), "file_name")).alias("locator"))
    conflict = (F.size("forms") > 1) | (F.size("days") > 1)
    return grouped.select("accession", "forms", "days", "literals", (F.col("rows") - F.col("literals")).alias("repeats"), conflict.alias("conflict"), F.when(~conflict, F.col("locator.file_name")).alias("locator"))


def bar_pages(bodies: DataFrame) -> DataFrame:
    """Bars of (path, body) pages, exact decimals; equal bars of a session collapse, and others are marked as conflicts.

    A bar's stamp must be midnight in New York, or it has no session.
    """
    bar = "struct<t string, o decimal(38,18), h decimal(38,18), l decimal(38,18), c decimal(38,18), v bigint>"
    pages = bodies.select("path", F.explode(F.from_json("body", f"struct<bars map<string, array<{bar}>>, next_page_token string>")["bars"]).alias("symbol", "bars"))
    rows = pages.select("symbol", F.explode("bars").alias("b"))
    local = F.from_utc_timestamp(F.to_timestamp("b.t"), "America/New_York")
    session = F.when(F.date_format(local, "HH:mm:ss") == "00:00:00", F.to_date(local))
    flat = rows.select("symbol", session.alias("session_date"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume")).distinct()
    from pyspark.sql import Window

    return flat.withColumn("conflict", F.count("*").over(Window.partitionBy("symbol", "session_date")) > 1)


def page_defects(pages: DataFrame, most: int = 100) -> DataFrame:
    """(request_id, defect) of paged answers (request_id, position, page_token, body, symbol, first_day, last_day).

    A request's pages follow one another by token, from none to none, at most ``most``, each token once; and
    their bars are of the symbol and within the days that were asked for.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("request_id").orderBy("position")
    answer = F.from_json("body", "struct<bars map<string, array<struct<t string>>>, next_page_token string>")
    rows = pages.withColumn("j", answer).withColumn("next", F.col("j.next_page_token"))
    rows = rows.withColumn("before", F.lag("next").over(w)).withColumn("k", F.row_number().over(w))
    days = F.transform(F.flatten(F.map_values("j.bars")), lambda b: F.to_date(F.from_utc_timestamp(F.to_timestamp(b["t"]), "America/New_York")))
    outside = F.exists(F.coalesce(days, F.array()), lambda d: (d < F.col("first_day")) | (d > F.col("last_day")))
    broken = F.when(F.col("k") == 1, F.col("page_token").isNotNull()).otherwise(~F.col("page_token").eqNullSafe(F.col("before")) | F.col("before").isNull())
    defect = F.when(parse.strict_json(F.col("body")).isNull(), "unreadable_page").when(broken, "broken_chain").when(F.size(F.array_except(F.map_keys("j.bars"), F.array("symbol"))) > 0, "other_symbol").when(outside, "bar_outside_request")
    each = rows.select("request_id", defect.alias("defect")).filter("defect IS NOT NULL").distinct()
    whole = rows.groupBy("request_id").agg(F.count("*").alias("n"), F.count("next").alias("tokens"), F.count_distinct("next").alias("kinds"), F.max_by(F.col("next").isNotNull(), "position").alias("open"))
    late = F.when(F.col("n") > most, "too_many_pages").when(F.col("tokens") > F.col("kinds"), "repeated_token").when(F.col("open"), "pages_missing")
    return each.union(whole.select("request_id", late.alias("defect")).filter("defect IS NOT NULL"))


def instrument_defects(bodies: DataFrame) -> DataFrame:
    """(path, defect) of mapping responses that are not one job, or whose job failed; a warning is an empty answer."""
    jobs = F.from_json("body", "array<struct<error string>>")
    defect = F.when(jobs.isNull(), "unreadable").when(F.size(jobs) != 1, "not_one_job").when(jobs[0]["error"].isNotNull(), "job_error")
    return bodies.select("path", defect.alias("defect")).filter("defect IS NOT NULL")


def instrument_claims(bodies: DataFrame, market_scope: str | None = None) -> DataFrame:
    """Identifier claims of (path, body) mapping responses: listing, share class, and the composite only with a scope."""
    item = "struct<figi string, shareClassFIGI string, compositeFIGI string, ticker string, exchCode string>"
    jobs = bodies.select("path", F.from_json("body", f"array<struct<data array<{item}>, warning string, error string>>").alias("jobs")).filter(F.size("jobs") == 1)
    rows = jobs.select("path", F.inline(F.coalesce(F.col("jobs")[0]["data"], F.array())))
    kinds = [("listing", "figi"), ("security", "shareClassFIGI")] + ([("composite", "compositeFIGI")] if market_scope else [])
    out = None
    for kind, column in kinds:
        part = rows.filter(F.col(column).isNotNull()).select("path", F.lit(kind).alias("level"), F.col(column).alias("value"), F.lit(market_scope if kind == "composite" else None).cast("string").alias("market_scope")).distinct()
        out = part if out is None else out.union(part)
    return out


def legal_entities(bodies: DataFrame, expected: str | None = None) -> DataFrame:
    """(path, id, name, exact) of (path, body) legal-entity responses; only an exact match may become a claim.

    With an ``expected`` id the response is of the exact kind: another id, or more than one row, raises when
    it is read. Without one, the rows are candidates by name and never claims.
    """
    item = "struct<type string, id string, attributes struct<entity struct<legalName struct<name string>>>>"
    rows = bodies.select("path", F.inline(F.from_json("body", f"struct<data array<{item}>>")["data"]))
    if expected:
        from pyspark.sql import Window

        alone = F.count("*").over(Window.partitionBy("path")) == 1
        rows = require(rows.withColumn("alone", alone), F.col("alone") & (F.col("id") == F.lit(expected)), "an exact response with another entity, or more than one").drop("alone")
    return rows.select("path", "id", F.col("attributes.entity.legalName.name").alias("name"), F.lit(bool(expected)).alias("exact"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def envelopes(spark: SparkSession, path: str, schema: str, id_field: str) -> DataFrame:
    """Records of an interchange envelope (record_id, payload_json); an id that disagrees with its payload raises when read."""
    rows = spark.read.schema("record_id string, payload_json string").parquet(path).select("record_id", F.from_json("payload_json", schema, {"mode": "FAILFAST"}).alias("r"))
    wrong = F.col(f"r.{id_field}") != F.col("record_id")
    return rows.withColumn("r", F.when(wrong, F.raise_error(F.concat(F.lit("payload id differs: "), "record_id"))).otherwise(F.col("r"))).select("r.*")
