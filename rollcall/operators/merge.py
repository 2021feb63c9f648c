"""Merging clusters to profiles, with a provenance row for every value that is taken.

Single values are chosen by ``min_by`` aggregates over the records. Lists go through one long table of items,
reduced by (cluster, field, key, source), then by key, then by cluster: no step gathers a cluster's records but for
their ids, which a profile lists. What several outputs share is written once to the shared folder: records are read twice.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SKILL_METHODS, Config
from ..functions.countries import normalize_country
from ..functions.dates import normalize_date
from ..functions.names import normalize_name
from ..functions.phones import digits, normalize_phones
from ..functions.skills import normalize_skill
from ..functions.strings import blank_to_null, bound, clean_list, exploded, strip, title_case
from ..functions.tables import lookup, map_literal, read_taxonomy
from ..functions.urls import normalize_url
from ..schema import LINKS, LOCATION, PROFILE, SKILL, conform
from ..shared import materialise, tasks

# How sure a stated value of each field is.
STATED = {
    "full_name": 0.95, "emails": 0.95, "phones": 0.90, "location": 0.85, "links.linkedin": 0.95, "links.github": 0.95, "links.portfolio": 0.85,
    "headline": 0.85, "years_experience": 0.80, "experience": 0.85, "education": 0.90,
}
FIELDS = ["full_name", "emails", "phones", "location", "links.linkedin", "links.github", "links.portfolio", "headline", "years_experience", "skills", "experience", "education"]


def trust_rank(source: Column, config: Config) -> Column:
    """Place in the trust order; unknown sources come last."""
    ranks = {s: str(i) for i, s in enumerate(config.trust_hierarchy)}
    return F.coalesce(lookup(map_literal(ranks), source).cast("int"), F.lit(len(ranks)))


def uuid5(seed: Column, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """Version 5 UUID of a name, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(seed, "UTF-8")))
    part = lambda at, n: F.substring(digest, at, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def identifiers(r: DataFrame) -> Column:
    """What a record adds to its profile's id: emails, digits of phones, profile links as they stand."""
    tagged = lambda kind, xs: F.transform(F.filter(xs, lambda x: x.isNotNull() & (x != "")), lambda x: F.concat(F.lit(f"{kind}:"), x))
    low = lambda c: F.lower(strip(c))
    return F.concat(
        tagged("email", F.transform(clean_list(r["emails"]), F.lower)), tagged("phone", F.transform(clean_list(r["phones"]), digits)),
        tagged("linkedin", F.array(low(F.col("links.linkedin")))), tagged("github", F.array(low(F.col("links.github")))),
    )


def prepared(records: DataFrame, clusters: DataFrame, config: Config) -> DataFrame:
    """Records with their cluster, trust rank and normalised values, dealt to tasks by the number of records."""
    n = tasks(clusters)
    r = records.repartition(n, "seq").join(clusters.repartition(n, "seq"), "seq")
    place = F.struct(title_case(blank_to_null(strip(F.col("location.city")))).alias("city"), title_case(blank_to_null(strip(F.col("location.region")))).alias("region"), normalize_country(F.col("location.country")).alias("country")).cast(LOCATION)
    stated = reduce(lambda a, k: a | F.coalesce(F.col(f"location.{k}") != "", F.lit(False)), ("city", "region", "country"), F.lit(False))
    return r.withColumns({
        "rank": trust_rank(F.col("source_type"), config),
        "v_full_name": normalize_name(F.col("full_name")),
        "v_location": F.when(stated, place),
        "v_headline": blank_to_null(strip(F.col("headline"))),
        "v_linkedin": normalize_url(F.col("links.linkedin")),
        "v_github": normalize_url(F.col("links.github")),
        "v_portfolio": normalize_url(F.col("links.portfolio")),
    })


def scalars(r: DataFrame, n: int) -> DataFrame:
    """One row a cluster: each single value as struct(value, source, path), with how many records state it, and its records."""
    picks = []
    ranked, first = F.struct("rank", "seq"), F.col("seq")
    for name, value, order in (
        ("full_name", "v_full_name", ranked), ("location", "v_location", ranked), ("headline", "v_headline", ranked), ("years_experience", "years_experience", ranked),
        ("linkedin", "v_linkedin", first), ("github", "v_github", first), ("portfolio", "v_portfolio", first),
    ):
        row = F.struct(F.col(value).alias("value"), F.col("source_type").alias("source"), F.col("source_path").alias("path"))
        picks.append(F.min_by(row, F.when(F.col(value).isNotNull(), order)).alias(name))
        picks.append(F.count(value).alias(f"n_{name}"))
    merged_from = F.transform(F.sort_array(F.collect_list(F.struct("seq", "record_id"))), lambda x: x["record_id"]).alias("merged_from")
    needed = r.select("cluster_id", "seq", "record_id", "rank", "source_type", "source_path", "years_experience", *(c for c in r.columns if c.startswith("v_")))
    return needed.repartition(n, "cluster_id").groupBy("cluster_id").agg(*picks, F.min_by("record_id", "seq").alias("first_record"), merged_from)


def items(r: DataFrame, config: Config) -> DataFrame:
    """(cluster_id, field, key, seq, pos, source, path, confidence, a..e): every list element of every record, normalised."""
    taxonomy = read_taxonomy(config.taxonomy_path)
    none = F.lit(None).cast("string")
    cell = lambda field, key, pos, *values: F.struct(F.lit(field).alias("field"), key.alias("key"), pos.cast("int").alias("pos"), *((values[i] if i < len(values) else none).alias("abcde"[i]) for i in range(5)))
    plain = lambda field, xs: F.transform(xs, lambda x, i: cell(field, x, i, x))
    phones = normalize_phones(F.col("phones"), config.default_phone_region)
    others = F.filter(F.transform(clean_list(F.col("links.other")), normalize_url), lambda u: u.isNotNull())
    skills = F.transform(F.transform(clean_list(F.col("skills")), lambda s: normalize_skill(s, taxonomy)), lambda s, i: cell("skills", F.lower(s), i, s))
    pair = lambda x, y: F.concat_ws("|", F.lower(F.coalesce(x, F.lit(""))), F.lower(F.coalesce(y, F.lit(""))))
    jobs = F.transform("experience", lambda e, i: cell("experience", pair(e["company"], e["title"]), i, e["company"], e["title"], normalize_date(e["start_date"]), normalize_date(e["end_date"]), e["description"]))
    studies = F.transform("education", lambda e, i: cell("education", pair(e["institution"], e["degree"]), i, e["institution"], e["degree"], e["field_of_study"], normalize_date(e["end_date"])))
    ids = F.transform(identifiers(r), lambda x, i: cell("id", x, i))
    names = F.transform(F.filter(F.array(F.lower(strip(F.col("full_name")))), lambda x: x.isNotNull() & (x != "")), lambda x, i: cell("name", x, i))
    lists = [plain("emails", F.transform(clean_list(F.col("emails")), F.lower)), plain("phones", phones), plain("links.other", others), skills, jobs, studies, ids, names]
    every = F.concat(*(F.coalesce(x, F.array().cast("array<struct<field:string,key:string,pos:int,a:string,b:string,c:string,d:string,e:string>>")) for x in lists))
    scores = map_literal({k: str(v) for k, v in config.source_base_scores.items()})
    score = F.coalesce(lookup(scores, F.col("source_type")).cast("double"), F.lit(0.5))
    return exploded(r, "cluster_id", "seq", F.col("source_type").alias("source"), F.col("source_path").alias("path"), score.alias("confidence"), i=every).select("cluster_id", "seq", "source", "path", "confidence", "i.*")


def distinct_items(rows: DataFrame, n: int) -> DataFrame:
    """One row for (cluster_id, field, key): its first mention, highest confidence and sources in order of mention."""
    order = F.struct("seq", "pos")
    by_source = rows.repartition(n, "cluster_id", "field", "key").groupBy("cluster_id", "field", "key", "source").agg(F.min(order).alias("at"), F.max("confidence").alias("confidence"), F.min_by(F.struct("path", "a", "b", "c", "d", "e"), order).alias("first"))
    return by_source.groupBy("cluster_id", "field", "key").agg(
        F.min("at").alias("at"), F.max("confidence").alias("confidence"), F.min_by(F.struct("source", "first.*"), "at").alias("first"), F.sort_array(F.collect_list(F.struct("at", "source"))).alias("sources")
    )


def gathered(found: DataFrame, n: int) -> DataFrame:
    """One row a cluster with its lists in order."""
    row = F.struct("at", "key", "confidence", F.transform("sources", lambda s: s["source"]).alias("sources"), F.col("first.a").alias("a"), F.col("first.b").alias("b"), F.col("first.c").alias("c"), F.col("first.d").alias("d"), F.col("first.e").alias("e"))
    lists = {f: F.sort_array(F.collect_list(F.when(F.col("field") == f, row))).alias(f.replace(".", "_")) for f in ("emails", "phones", "links.other", "skills", "experience", "education")}
    keys = {f: F.sort_array(F.collect_list(F.when(F.col("field") == f, F.col("key")))).alias(f"{f}_keys") for f in ("id", "name")}
    return found.repartition(n, "cluster_id").groupBy("cluster_id").agg(*lists.values(), *keys.values())


def provenance_rows(one: DataFrame, found: DataFrame, rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(candidate_id, ord, field, value, source, source_path, method, confidence): values as JSON text, in order of emission."""
    methods = map_literal(SKILL_METHODS)

    def line(field: Column, value: Column, source: Column, path: Column, method: Column, confidence: Column, order: str, seq: Column, pos: Column) -> Column:
        place = F.struct(F.lit(FIELDS.index(order)).alias("step"), seq.cast("bigint").alias("seq"), pos.cast("int").alias("pos"))
        return F.struct(place.alias("ord"), field.alias("field"), value.alias("value"), source.alias("source"), path.alias("source_path"), method.alias("method"), confidence.cast("double").alias("confidence"))

    zero, direct = F.lit(0), F.lit("direct_assertion")
    quoted = lambda c: F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    json = lambda c: bound(quoted(c), lambda x: F.substr(x, F.lit(len('{"v":') + 1), F.length(x) - len('{"v":}')))
    single = []
    for field in FIELDS:
        name = field.removeprefix("links.")
        if name in ("emails", "phones", "skills", "experience", "education"):
            continue
        pick = F.col(name)
        resolved = F.when(F.col(f"n_{name}") > 1, "conflict_resolution").otherwise("direct_assertion") if name in ("full_name", "years_experience") else direct
        single.append(F.when(pick.isNotNull(), line(F.lit(field), json(pick["value"]), pick["source"], pick["path"], resolved, F.lit(STATED[field]), field, zero, zero)))
    from_one = exploded(one, "cluster_id", p=F.array(*single))

    first = F.col("first")
    named = lambda prefix: F.concat(F.lit(prefix + "."), F.coalesce(blank_to_null(first["a"]), F.lit("unknown")))
    job = json(F.struct(*(first[x].alias(y) for x, y in zip("abcde", ("company", "title", "start", "end", "summary"), strict=True))))
    study = json(F.struct(*(first[x].alias(y) for x, y in zip("abcd", ("institution", "degree", "field", "end_year"), strict=True))))
    shape = lambda field, path, value: line(path, value, first["source"], first["path"], direct, F.lit(STATED[field]), field, F.col("at.seq"), F.col("at.pos"))
    kind = F.col("field")
    listed = F.when(kind == "emails", shape("emails", kind, json(first["a"]))).when(kind == "phones", shape("phones", kind, json(first["a"])))
    listed = listed.when(kind == "experience", shape("experience", named("experience"), job)).when(kind == "education", shape("education", named("education"), study))
    from_found = found.select("cluster_id", listed.alias("p")).where("p is not null")

    mention = line(F.concat(F.lit("skills."), F.col("a")), json(F.col("a")), F.col("source"), F.col("path"), F.coalesce(lookup(methods, F.col("source")), F.lit("inferred")), F.col("confidence"), "skills", F.col("seq"), F.col("pos"))
    from_rows = rows.where("field = 'skills'").select("cluster_id", mention.alias("p"))
    every = from_one.union(from_found).union(from_rows).repartition(n, "cluster_id")
    return every.join(ids.repartition(n, "cluster_id").hint("shuffle_hash"), "cluster_id").select("candidate_id", "p.*")


def candidate_id(one: DataFrame) -> Column:
    """UUID 5 of the sorted identifiers, else of the sorted names, else of the first record's id."""
    return uuid5(
        F.when(F.size("id_keys") > 0, F.array_join("id_keys", "|"))
        .when(F.size("name_keys") > 0, F.concat(F.lit("name:"), F.array_join("name_keys", "|")))
        .otherwise(F.concat(F.lit("record:"), F.col("first_record")))
    )


def merge(records: DataFrame, clusters: DataFrame, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(profiles, provenance) of clustered records; profiles also have ``cluster_id`` and no confidence yet.

    Null lists count as empty. Records without a cluster are left out. Runs jobs: the profiles are a written table.
    """
    config = config or Config()
    r, n = prepared(records, clusters, config), tasks(clusters)
    one = materialise(scalars(r, n))
    rows = materialise(items(r, config))
    found = materialise(distinct_items(rows, n))
    lists = gathered(found, n)
    empty = lambda name: F.coalesce(F.col(name), F.array())
    whole = one.repartition(n, "cluster_id").join(lists, "cluster_id", "left").withColumns({k: F.coalesce(F.col(k), F.array().cast("array<string>")) for k in ("id_keys", "name_keys")})
    plain = lambda name: F.transform(empty(name), lambda x: x["a"])
    # by falling confidence; in order of mention at the same
    skills = F.transform(F.array_sort(F.transform(empty("skills"), lambda s: F.struct((-s["confidence"]).alias("o"), s["at"].alias("at"), s.alias("s")))), lambda x: F.struct(x["s"]["a"].alias("name"), x["s"]["confidence"].alias("confidence"), x["s"]["sources"].alias("sources")))
    as_structs = lambda name, *fields: F.transform(empty(name), lambda x: F.struct(*(x["abcde"[i]].alias(f) for i, f in enumerate(fields))))
    profiles = whole.withColumns({
        "candidate_id": candidate_id(whole), "v_links": F.struct(F.col("linkedin.value").alias("linkedin"), F.col("github.value").alias("github"), F.col("portfolio.value").alias("portfolio"), plain("links_other").alias("other")).cast(LINKS),
        "v_emails": plain("emails"), "v_phones": plain("phones"), "v_skills": skills.cast(f"array<{SKILL}>"),
        "v_experience": as_structs("experience", "company", "title", "start", "end", "summary"), "v_education": as_structs("education", "institution", "degree", "field", "end_year"),
    }).select(
        "cluster_id", "candidate_id", F.col("full_name.value").alias("full_name"), F.col("v_emails").alias("emails"), F.col("v_phones").alias("phones"), F.col("location.value").alias("location"),
        F.col("v_links").alias("links"), F.col("headline.value").alias("headline"), F.col("years_experience.value").alias("years_experience"), F.col("v_skills").alias("skills"),
        F.col("v_experience").alias("experience"), F.col("v_education").alias("education"), F.lit(0.0).alias("overall_confidence"), "merged_from",
    )
    profiles = materialise(conform(profiles, {"cluster_id": "bigint"} | PROFILE))
    return profiles, provenance_rows(one, found, rows, profiles.select("cluster_id", "candidate_id"), n)


def resolution(field: str, values: DataFrame, config: Config | None = None) -> DataFrame:
    """(cluster_id, field, conflict, chosen_value, chosen_source, chosen_reason, rejected) of stated values (cluster_id, seq, source_type, value)."""
    config = config or Config()
    stated = values.where("value is not null").withColumn("trust_rank", trust_rank(F.col("source_type"), config))
    every = stated.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("trust_rank", "seq", "value", F.col("source_type").alias("source")))).alias("all"))
    best = F.get("all", F.lit(0))
    reason = F.concat(F.lit("Source '"), best["source"], F.lit("' has highest trust rank ("), best["trust_rank"].cast("string"), F.lit(")"))
    rest = F.transform(F.slice("all", F.lit(2), F.size("all")), lambda x: F.struct(x["value"].alias("value"), x["source"].alias("source"), x["trust_rank"].alias("trust_rank")))
    return every.select("cluster_id", F.lit(field).alias("field"), (F.size("all") > 1).alias("conflict"), best["value"].alias("chosen_value"), best["source"].alias("chosen_source"), F.when(F.size("all") > 1, reason).alias("chosen_reason"), rest.alias("rejected"))
