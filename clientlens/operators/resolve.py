"""Unify & resolve the two banks' clients (ER-01..ER-10).

The reference only describes this step; the design here is ours:

* **staging** (ER-01/02/03) maps each bank's raw record to canonical
  columns (names un-mutated, dates parsed, countries canonical, e-mail local
  part without trailing digits, phone digits) and unions them;
* **candidates** (ER-04): records that share an identifying key, ``dob|phone``,
  ``dob|name_norm`` (name tokens, lower-cased and sorted) or ``dob|email_local``.
  A local part that different names share identifies nobody and gives no key.
  Copies are linked as such, each other record is a candidate of the key's first
  one, and those that it does not link are compared with all others of the key,
  block by block: only strangers under one key cost the square of their number;
* **links** (ER-06): a candidate pair is scored (name, e-mail, phone, birth
  date, city; features that a side lacks do not count) and linked only from
  ``LINK_AT`` on;
* **clusters** (ER-07): connected components of the links;
* **scores** (ER-06): every record against its cluster's golden record
  (Levenshtein name similarity, soundex, e-mail, phone, city, dob) →
  match / review / no — linear in the number of records;
* **golden record** (ER-09): per column the first non-null value by source
  priority (``min_by``), ``source_banks`` sorted, ``dual_banked``;
* **accuracy** (ER-08): pairwise precision / recall / F1 from the
  cluster × truth contingency counts (Σ C(n, 2)), again without pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_dmy, parse_iso
from ..functions.text import canonical_country, canonical_name, digits_only, email_local
from ..session import written
from .components import connected_components
from .similar_pairs import candidate_pairs, fewest_edits, signature

SOURCE_PRIORITY = {"apex": 0, "summit": 1}
STAGED_COLUMNS = ["record_id", "source_bank", "source_key", "full_name", "name_norm", "is_entity", "dob",
                  "domicile", "booking_centre", "segment_tier", "risk_profile", "kyc_status", "languages",
                  "email", "email_local", "phone", "address_line", "city", "currency"]
# Pair-score weights (ours) and decision thresholds.
SCORE_WEIGHTS = {"name": 0.30, "soundex": 0.10, "email": 0.20, "phone": 0.20, "city": 0.05, "dob": 0.15}
# Weights and threshold of a link between two records (ours).
LINK_WEIGHTS = {"name_norm": 0.40, "email_local": 0.15, "phone": 0.20, "dob": 0.15, "city": 0.10}
LINK_AT = 0.80
# Members up to which all pairs of a key are compared.
FEW = 32
# Rows of a block of a key's nameless members that are compared with those of another.
PAIR_BLOCK = 1024
MATCH_AT = 0.80
REVIEW_AT = 0.50


def name_norm(c) -> F.Column:
    toks = F.split(F.lower(canonical_name(c)), r"[^\p{L}\p{N}]+")
    return F.array_join(F.array_sort(F.filter(toks, lambda t: t != F.lit(""))), " ")


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("record_id", F.concat_ws(":", "source_bank", "source_key")).select(*STAGED_COLUMNS)


def stage_bank_a(raw: DataFrame) -> DataFrame:
    """ER-01: bank A CSV rows → canonical staged rows."""
    return _finish(raw.select(
        F.lit("apex").alias("source_bank"), F.col("kunde_nr").alias("source_key"),
        canonical_name("name").alias("full_name"), name_norm("name").alias("name_norm"),
        F.lit(None).cast("boolean").alias("is_entity"),
        parse_dmy("geburtsdatum").alias("dob"), canonical_country("domizil").alias("domicile"),
        F.col("buchungszentrum").alias("booking_centre"), F.col("segment").alias("segment_tier"),
        F.col("risiko_profil").alias("risk_profile"), F.lower("kyc_status").alias("kyc_status"),
        F.array_join(F.array_sort(F.split("sprachen", ";")), "|").alias("languages"),
        F.lower("email").alias("email"), email_local("email").alias("email_local"),
        digits_only("telefon").alias("phone"), F.col("adresse").alias("address_line"), F.col("ort").alias("city"),
        F.col("waehrung").alias("currency")))


def stage_bank_b(raw: DataFrame) -> DataFrame:
    """ER-02: bank B nested JSON rows → canonical staged rows."""
    return _finish(raw.select(
        F.lit("summit").alias("source_bank"), F.col("cifNumber").alias("source_key"),
        canonical_name("client.displayName").alias("full_name"), name_norm("client.displayName").alias("name_norm"),
        F.col("client.isLegalEntity").alias("is_entity"), parse_iso("client.dateOfBirth").alias("dob"),
        canonical_country("address.country").alias("domicile"), F.col("booking.center").alias("booking_centre"),
        F.col("client.clientSegment").alias("segment_tier"), F.col("client.riskProfile").alias("risk_profile"),
        F.lower("kyc.status").alias("kyc_status"),
        F.array_join(F.array_sort("client.languages"), "|").alias("languages"),
        F.lower("contact.email").alias("email"), email_local("contact.email").alias("email_local"),
        digits_only("contact.phone").alias("phone"), F.col("address.line1").alias("address_line"),
        F.col("address.city").alias("city"), F.col("booking.baseCcy").alias("currency")))


def inbound(*staged: DataFrame) -> DataFrame:
    """ER-03: union of the staged sources."""
    out = staged[0]
    for s in staged[1:]:
        out = out.unionByName(s)
    return out


def blocking_keys(records: DataFrame) -> DataFrame:
    """ER-04: (record_id, key); NULL / empty components give no key."""
    def key(tag, *cols):
        ok = F.lit(True)
        for c in cols:
            ok = ok & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        return F.when(ok, F.concat_ws("|", F.lit(tag), *[F.col(c).cast("string") for c in cols]))
    shared = (records.where("email_local is not null").groupBy("email_local")
              .agg(F.min("name_norm").alias("lo"), F.max("name_norm").alias("hi")).where("lo <> hi").select("email_local"))
    by_person = F.filter(F.array(key("p", "dob", "phone"), key("n", "dob", "name_norm")), lambda x: x.isNotNull())
    by_email = records.join(shared, "email_local", "left_anti").select("record_id", key("e", "dob", "email_local").alias("key"))
    return records.select("record_id", F.explode(by_person).alias("key")).union(by_email.where("key is not null"))


def _alike(x, y) -> F.Column:
    return 1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def link_score(x: str, y: str) -> F.Column:
    """ER-06: similarity of two records (structs ``x`` and ``y``), 0 to 1, over
    the features that both have."""
    total = weight = F.lit(0.0)
    for name, w in LINK_WEIGHTS.items():
        a, b = F.col(f"{x}.{name}"), F.col(f"{y}.{name}")
        both = a.isNotNull() & b.isNotNull()
        same = (a == b).cast("double") if name in ("dob", "city") else _alike(a, b)
        total = total + F.when(both, w * same).otherwise(0.0)
        weight = weight + F.when(both, F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(0.0)


def scored_links(records: DataFrame) -> DataFrame:
    """ER-04 + ER-06: pairs (a, b) of a key with their score: copies, each
    record with the key's first one, and of all others those that link."""
    have = [c for c in LINK_WEIGHTS if c in records.columns]
    def feature(c: str) -> F.Column:
        # an empty text is a feature that the record lacks
        own = F.col(c) if c in have else F.lit(None).cast("string")
        return (F.nullif(own, F.lit("")) if c not in have or dict(records.dtypes)[c] == "string" else own).alias(c)
    features = F.struct(*[feature(c) for c in LINK_WEIGHTS])
    members = written(blocking_keys(records).join(records.select("record_id", features.alias("f")), "record_id").select("key", "record_id", "f"))
    distinct = written(members.groupBy("key", "f").agg(F.min("record_id").alias("id")))
    copies = (members.join(distinct, ["key", "f"]).where("record_id <> id")
              .select(F.col("record_id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score")))
    first = distinct.groupBy("key").agg(F.min(F.struct("id", F.col("f").alias("y"))).alias("first"), F.count("*").alias("n"))
    star = written(distinct.withColumnRenamed("f", "x").join(first.select("key", "n", F.col("first.id").alias("b"), F.col("first.y").alias("y")), "key")
                   .where("id <> b").select("key", "n", F.col("id").alias("a"), "x", "b", link_score("x", "y").alias("score")))
    return copies.union(star.select("a", "b", "score")).union(_links_beside_first(star.where("n > 2")))


def _bounds() -> tuple[float, float, float, float]:
    """What a link asks of its features: similarity of the names in different
    cities; of names in one city and, third, where a city is not known, each
    unless the e-mails are alike; and of the e-mails then. The features may lack
    ``1 - LINK_AT`` of the weight in sum: a different city takes its weight of
    that, and what a side does not have makes the sum smaller."""
    name, mail, city, lack = LINK_WEIGHTS["name_norm"], LINK_WEIGHTS["email_local"], LINK_WEIGHTS["city"], 1 - LINK_AT
    elsewhere = 1 - (lack - city) / name
    here, unknown = (1 - lack * (1 - mail - c) / name for c in (0, city))
    mails = min(1 - (lack - name * (1 - here)) / mail, 1 - (lack * (1 - city) - name * (1 - unknown)) / mail)
    return elsewhere, here, unknown, mails


def _links_beside_first(star: DataFrame) -> DataFrame:
    """Links of a key's members that the first one does not link, among
    themselves and with those it does (these are one cluster already).

    Keys of up to ``FEW`` members are compared pair by pair. In larger ones the
    candidates come from the bounds of :func:`_bounds`, by the rarest bigrams
    of names and e-mails; records without a name are compared with all others
    of their key, in pairs of blocks of ``PAIR_BLOCK`` rows."""
    apart = F.col("score") < LINK_AT
    rows = star.select("key", F.col("a").alias("id"), F.col("x").alias("f"), apart.alias("apart"))
    sizes = (rows.groupBy("key").agg(F.count_if("apart").alias("n_apart"), F.count("*").alias("n"), F.count_if(F.expr("f.city is null")).alias("no_city"), F.count_if(F.expr("f.name_norm is null")).alias("no_name"))
             .where("n_apart > 0 and n > 1"))
    members = written(rows.join(sizes, "key").withColumn("id", F.struct("key", "id")))
    few, many = members.where(F.col("n") <= FEW), members.where(F.col("n") > FEW)
    x, y = few.alias("x"), few.alias("y")
    small = (x.join(y, (F.col("x.key") == F.col("y.key")) & F.expr("x.id < y.id and (x.apart or y.apart)"))
             .select(F.col("x.id").alias("a"), F.col("x.f").alias("x"), F.col("y.id").alias("b"), F.col("y.f").alias("y")))
    pairs = hot_candidates(many)
    one = many.select(F.col("id").alias("a"), F.col("f").alias("x"))
    other = many.select(F.col("id").alias("b"), F.col("f").alias("y"))
    large = pairs.join(one, "a").join(other, "b").select("a", "x", "b", "y")
    found = small.unionByName(large).unionByName(_nameless_pairs(many.where("no_name > 0")))
    score = link_score("x", "y")
    return found.where(score >= LINK_AT).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), score.alias("score")).distinct()


def hot_candidates(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``members(key, id, f, apart, no_city)`` with names that
    may link: every link is among them (records without a name aside)."""
    elsewhere, here, unknown, mails = _bounds()
    named = written(members.where("f.name_norm is not null").select(
        "key", "id", "f", "apart", F.expr("f.city is null").alias("no_city"), F.expr("no_city > 0").alias("some"),
        F.expr(signature("f.name_norm")).alias("name"), F.expr(signature("f.email_local")).alias("mail")))
    in_city = named.where("not no_city").withColumn("block", F.struct("key", F.concat(F.lit("="), "f.city").alias("city")))
    anywhere = named.withColumn("block", F.struct("key", F.lit("").alias("city")))

    def may_link(city_lacks: float, city_known: bool) -> str:
        # what name, e-mail and city lack at least, against what all may lack
        w, lack = LINK_WEIGHTS, 1 - LINK_AT
        name, mail = (f"{w[f]} * least(1.0D, {fewest_edits('x.' + c, 'y.' + c)} / greatest(x.{c}.n, y.{c}.n))" for f, c in (("name_norm", "name"), ("email_local", "mail")))
        weight = 1.0 - (0 if city_known else w["city"])
        no_mail = "x.mail IS NULL OR y.mail IS NULL"
        return (f"(x.apart or y.apart) and {name} + CASE WHEN {no_mail} THEN 0D ELSE {mail} END + {city_lacks!r}D <= "
                f"{lack!r}D * ({weight!r}D - CASE WHEN {no_mail} THEN {w['email_local']!r}D ELSE 0D END) + 1e-9D")

    def text(rows: DataFrame, feature: str) -> DataFrame:
        return rows.withColumn("text", F.col(f"f.{feature}")).where("text is not null").select("block", "id", "text", "apart", "no_city", "name", "mail")
    same, other, not_known = may_link(0.0, True), may_link(LINK_WEIGHTS["city"], True), f"(x.no_city or y.no_city) and {may_link(0.0, False)}"
    found = (candidate_pairs(text(anywhere.where("not no_city"), "name_norm"), elsewhere, other)
             .union(candidate_pairs(text(in_city, "name_norm"), here, same))
             .union(candidate_pairs(text(in_city, "email_local"), mails, same))
             .union(candidate_pairs(text(anywhere.where("some"), "name_norm"), unknown, not_known))
             .union(candidate_pairs(text(anywhere.where("some"), "email_local"), mails, not_known)))
    return found.select("a", "b").distinct()


def _nameless_pairs(members: DataFrame) -> DataFrame:
    """Records without a name beside all of their key, in pairs of blocks."""
    blocks = {side: F.ceil(F.col(n) / PAIR_BLOCK) for side, n in (("left", "no_name"), ("right", "n"))}

    def dealt(own: str, other: str, rows: DataFrame, id_: str, f: str) -> DataFrame:
        return (rows.withColumn(f"{own}_block", F.pmod(F.xxhash64("id"), blocks[own])).withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks[other] - F.lit(1).cast("long"))))
                .select("key", "left_block", "right_block", F.col("id").alias(id_), F.col("f").alias(f), F.col("apart").alias(f"{id_}_apart")))
    pairs = dealt("left", "right", members.where("f.name_norm is null"), "a", "x").join(dealt("right", "left", members, "b", "y"), ["key", "left_block", "right_block"])
    return pairs.where("(a_apart or b_apart) and (a < b or (a > b and y.name_norm is not null))").select("a", "x", "b", "y")


def resolve(records: DataFrame) -> DataFrame:
    """Staged records with their cluster id (records without a link are
    their own cluster)."""
    found = connected_components(scored_links(records).where(F.col("score") >= LINK_AT))
    return (records.join(found.withColumnRenamed("node", "record_id"), "record_id", "left")
            .withColumn("cluster_id", F.coalesce("component", "record_id")).drop("component"))


def golden_records(resolved: DataFrame) -> DataFrame:
    """ER-09: one row per cluster; first non-null value by source priority."""
    prio = F.coalesce(*[F.when(F.col("source_bank") == b, F.lit(p)) for b, p in SOURCE_PRIORITY.items()], F.lit(99))
    r = resolved.withColumn("_prio", prio)
    cols = ["full_name", "is_entity", "dob", "domicile", "booking_centre", "segment_tier", "risk_profile",
            "kyc_status", "languages", "email", "phone", "address_line", "city", "currency"]
    # non-null first, then source priority, then record id (deterministic)
    aggs = [F.min_by(F.col(c), F.struct(F.col(c).isNull(), F.col("_prio"), F.col("record_id"))).alias(c)
            for c in cols]
    return (r.groupBy("cluster_id")
            .agg(*aggs, F.array_join(F.array_sort(F.collect_set("source_bank")), "|").alias("source_banks"),
                 F.count("*").alias("n_records"), F.min("record_id").alias("first_record"))
            .withColumn("dual_banked", F.instr("source_banks", "|") > 0))


def record_scores(resolved: DataFrame, golden: DataFrame) -> DataFrame:
    """ER-06: each record scored against its cluster's golden record."""
    g = golden.select("cluster_id", *[F.col(c).alias(f"g_{c}") for c in
                                      ["full_name", "email", "phone", "city", "dob"]])
    j = resolved.join(g, "cluster_id")
    n1, n2 = F.lower(F.col("full_name")), F.lower(F.col("g_full_name"))
    name_sim = F.lit(1.0) - F.levenshtein(n1, n2) / F.greatest(F.length(n1), F.length(n2), F.lit(1))
    feats = {
        "name": F.coalesce(name_sim, F.lit(0.0)),
        "soundex": F.coalesce((F.soundex("full_name") == F.soundex("g_full_name")).cast("double"), F.lit(0.0)),
        "email": F.coalesce((email_local("email") == email_local("g_email")).cast("double"), F.lit(0.0)),
        "phone": F.coalesce((F.col("phone") == F.col("g_phone")).cast("double"), F.lit(0.0)),
        "city": F.coalesce((F.col("city") == F.col("g_city")).cast("double"), F.lit(0.0)),
        "dob": F.coalesce((F.col("dob") == F.col("g_dob")).cast("double"), F.lit(0.0)),
    }
    score = sum((F.lit(w) * feats[k] for k, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    return j.select("record_id", "cluster_id", "source_bank", F.round(score, 4).alias("score"),
                    F.when(score >= MATCH_AT, "match").when(score >= REVIEW_AT, "review").otherwise("no")
                    .alias("decision"))


def pairwise_accuracy(resolved: DataFrame, truth: DataFrame) -> DataFrame:
    """ER-08: pairwise precision / recall / F1 against ``truth``
    (record_id, master_id) from contingency counts — no pairs built."""
    j = resolved.select("record_id", "cluster_id").join(truth.select("record_id", "master_id"), "record_id")

    def pairs(col):
        return F.sum(F.col(col) * (F.col(col) - 1) / 2)
    tp = j.groupBy("cluster_id", "master_id").agg(F.count("*").alias("n")).agg(pairs("n").alias("tp"))
    pred = j.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(pairs("n").alias("pred"))
    true = j.groupBy("master_id").agg(F.count("*").alias("n")).agg(pairs("n").alias("true"))
    t, p, r = tp.scalar(), pred.scalar(), true.scalar()
    prec = F.when(p > 0, t / p).otherwise(F.lit(1.0))
    rec = F.when(r > 0, t / r).otherwise(F.lit(1.0))
    return j.sparkSession.range(1).select(
        t.cast("long").alias("true_positive_pairs"), p.cast("long").alias("predicted_pairs"),
        r.cast("long").alias("true_pairs"), F.round(prec, 4).alias("precision"), F.round(rec, 4).alias("recall"),
        F.round(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)), 4).alias("f1"))


def unify_report(staged: DataFrame, golden: DataFrame, accuracy: DataFrame) -> DataFrame:
    """ER-10 / AGG-21: mapped-field share per source, cluster count, accuracy
    and one before/after example (JSN-03)."""
    fields = [c for c in STAGED_COLUMNS if c not in ("record_id", "source_bank", "source_key")]
    filled = sum((F.col(c).isNotNull().cast("long") for c in fields), F.lit(0))
    per_src = (staged.groupBy("source_bank")
               .agg(F.count("*").alias("rows"), F.round(F.avg(filled) / len(fields) * 100, 1).alias("pct_fields_mapped")))
    example = golden.filter("dual_banked").orderBy("cluster_id").limit(1)
    return (per_src
            .withColumn("clusters", golden.agg(F.count("*")).scalar())
            .withColumn("dual_banked_clusters", golden.agg(F.count_if("dual_banked")).scalar())
            .withColumn("f1", accuracy.select("f1").scalar())
            .withColumn("after_example", example.select(F.to_json(F.struct("*"))).scalar()))
