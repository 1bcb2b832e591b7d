"""The given tables seen as the tables of each analysis.

Only projections and lookups: every function covers all rows of the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import labels as L
from ..functions.dates import day
from ..functions.numeric import flag, half_even
from ..operators.joins import lookup_join
from ..sources.tables import load


def _rows(spark: SparkSession, folder: str, table: str, **columns: Column | str) -> DataFrame:
    df = load(spark, folder, table)
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


# Donors ---------------------------------------------------------------------------------------


def donor_users(spark: SparkSession, folder: str) -> DataFrame:
    users = _rows(
        spark, folder, "customer", id="c_custkey", nation="c_nationkey",
        confirmed_donations=F.floor(F.col("c_acctbal") / 100).cast("int"),
        autho_vk=F.when(F.col("c_nationkey") > 2, F.col("c_mktsegment") == "BUILDING"),
        autho_ok=F.col("c_acctbal") > 8000,
        autho_tg=F.col("c_nationkey") < 3,
        autho_yandex=F.col("c_mktsegment") == "MACHINERY",
        autho_google=F.col("c_acctbal") < 1000,
        balance="c_acctbal",
    )
    nations = _rows(spark, folder, "nation", nation="n_nationkey", n_name="n_name")
    region = F.when(F.col("balance") >= 0, F.col("n_name"))
    return lookup_join(users, nations, "nation", "left").withColumn("region", region).drop("nation", "n_name", "balance")


def donations(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, "orders", id="o_orderkey", user_id="o_custkey", donation_date="o_orderdate")


def donor_bonuses(spark: SparkSession, folder: str) -> DataFrame:
    """Several rows per user: one per order status of urgent orders."""
    urgent = load(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return urgent.groupBy(F.col("o_custkey").alias("user_id"), "o_orderstatus").agg(
        (F.count("*") - 1).alias("user_bonus_count")
    ).drop("o_orderstatus")


def donation_plan(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(
        spark, folder, "orders", user_id="o_custkey", donation_date=day("o_orderdate"), donation_type="o_orderstatus"
    )


def performed_donations(spark: SparkSession, folder: str) -> DataFrame:
    lines = _rows(spark, folder, "lineitem", order="l_orderkey", donation_date=day("l_shipdate"))
    owners = _rows(spark, folder, "orders", order="o_orderkey", user_id="o_custkey")
    return lookup_join(lines, owners, "order").select("user_id", "donation_date")


# Real estate ----------------------------------------------------------------------------------


def measured_flats(spark: SparkSession, folder: str) -> DataFrame:
    """All flats, before their place is looked up."""
    base = _rows(
        spark, folder, "lineitem", id="l_orderkey", part="l_partkey", supplier="l_suppkey",
        total_area="l_quantity",
        balcony=F.when(F.col("l_returnflag") != "A", F.col("l_linenumber")),
        ceiling_height=F.when(F.col("l_discount") > 0, F.col("l_tax") * 10 + 2.5),
        floors_total=F.col("l_linenumber") * 3,
    )
    parts = _rows(spark, folder, "part", part="p_partkey", type_id="p_type", rooms=F.nullif(F.col("p_size"), F.lit(1)))
    return lookup_join(base, parts, "part").drop("part")


def flats(spark: SparkSession, folder: str) -> DataFrame:
    places = _rows(spark, folder, "supplier", supplier="s_suppkey", city_id="s_nationkey")
    return lookup_join(measured_flats(spark, folder), places, "supplier", "left").drop("supplier")


def advertisements(spark: SparkSession, folder: str) -> DataFrame:
    """Days on the market come in halves, and are missing while the flat is still listed."""
    return _rows(
        spark, folder, "orders", id="o_orderkey", first_day_exposition="o_orderdate",
        days_exposition=F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 500) / 2),
        last_price="o_totalprice",
    )


def cities(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, "nation", city_id="n_nationkey", city="n_name")


# Vacancies ------------------------------------------------------------------------------------


def vacancies(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_chars")
    return _rows(
        spark, folder, "documents", name="text", area="lang",
        employer=F.when(F.col("source") != "src0", F.col("source")),
        employment=F.when(n < 1000, "part time").otherwise("full time"),
        schedule=F.when(F.col("lang") == "en", "office").otherwise("remote"),
        experience=L.segment(n, [(None, 499, "none"), (500, 1999, "1-3 years"), (2000, 7999, "3-6 years")], "6+ years"),
        salary_from=F.when(n >= 100, n.cast("decimal(18,2)")),
        salary_to=F.when(n < 20000, (n * 2 + 1).cast("decimal(18,2)")),
    )


def vacancy_skills(spark: SparkSession, folder: str) -> DataFrame:
    """Sibling skill columns with gaps and, for the soft skills, leading blanks."""
    size = F.col("p_size")
    return _rows(
        spark, folder, "part",
        key_skills_1=F.split_part("p_name", F.lit(" "), F.lit(1)),
        key_skills_2=F.when(size > 5, F.split_part("p_name", F.lit(" "), F.lit(2))),
        key_skills_3=F.when(size > 10, F.col("p_brand")),
        key_skills_4=F.when(size > 20, F.col("p_type")),
        soft_skills_1=F.concat(F.lit(" "), F.col("p_type")),
        soft_skills_2=F.when(size > 15, F.concat(F.lit("  "), F.split_part("p_name", F.lit(" "), F.lit(1)))),
        soft_skills_3=F.when(size > 25, F.col("p_type")),
        soft_skills_4=F.when(size > 40, F.concat(F.lit(" "), F.col("p_brand"))),
    )


# Shop test ------------------------------------------------------------------------------------

SHOP_TEST = "payment_test"


def arm() -> Column:
    return F.when(F.col("user_id") % 2 == 0, "A").otherwise("B")


def pages() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def participants(spark: SparkSession, folder: str) -> DataFrame:
    """Everyone is in the payment test; users with costly errors are in a second one as well."""
    events = load(spark, folder, "events")
    first = events.select("user_id", arm().alias("group"), F.lit(SHOP_TEST).alias("ab_test"))
    second = events.filter((F.col("event_type") == "error") & (F.col("value") > 100))
    second = second.select("user_id", F.lit("B").alias("group"), F.lit("recommender_test").alias("ab_test"))
    return first.unionByName(second).distinct()


CUSTOMER_FILE = "user_id bigint, region string, revenue double, seen date"


def customer_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as lines of a CSV file, some of them broken, with the file's header and blank lines between."""
    row = F.struct(
        F.col("c_custkey").alias("user_id"), F.concat(F.col("c_mktsegment"), F.lit(", \""), F.col("c_nationkey"), F.lit('"')).alias("region"),
        F.col("c_acctbal").alias("revenue"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("c_custkey", F.lit(300)).cast("int")).alias("seen"),
    )
    sound = F.to_csv(row, {"escape": '"', "quoteAll": "true"})
    kind = F.pmod("c_custkey", F.lit(40))
    line = (
        F.when(kind == 1, F.regexp_replace(sound, r'"[^"]*"$', '"2024-02-31"'))
        .when(kind == 2, F.regexp_replace(sound, r',"[^"]*"$', ""))
        .when(kind == 3, F.concat(sound, F.lit(",more")))
        .when(kind == 4, F.concat(F.lit('"'), sound))
        .when(kind == 5, F.regexp_replace(sound, '^"[^"]*"', '"x1"'))
        .otherwise(sound)
    )
    more = F.when(kind == 0, F.array(F.lit("user_id,region,revenue,seen"), F.lit("  "), line)).otherwise(F.array(line))
    return load(spark, folder, "customer").select(F.explode(more).alias("line"))


def new_users(spark: SparkSession, folder: str) -> DataFrame:
    seen = load(spark, folder, "events").groupBy("user_id").agg(F.min(day("ts")).alias("first_date"))
    people = _rows(spark, folder, "customer", user_id="c_custkey", nation="c_nationkey", device="c_mktsegment")
    nations = _rows(spark, folder, "nation", nation="n_nationkey", region="n_name")
    return lookup_join(lookup_join(seen, people, "user_id"), nations, "nation").drop("nation")


def shop_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, "events", user_id="user_id", session_start=day("ts"), session_duration="value")


def shop_purchases(spark: SparkSession, folder: str) -> DataFrame:
    """A purchase counts when it reached 100."""
    sales = load(spark, folder, "events").filter((F.col("event_type") == "purchase") & (F.col("value") >= 100))
    return sales.select("user_id", day("ts").alias("event_dt"), F.col("value").alias("revenue"))


# Feed sessions --------------------------------------------------------------------------------


def feed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """One event is one session; a purchase on the first four pages lands in the other arm."""
    return _rows(
        spark, folder, "events", user_id="user_id", session_id="event_id", session_date=day("ts"),
        session_start_ts="ts", registration_flag=flag(F.col("event_type") == "signup"),
        page_counter=pages(), device="event_type", test_group=arm(),
    )


def leaky_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions in which some purchases were logged under the wrong arm."""
    wrong = (F.col("event_type") == "purchase") & (F.col("value") > 200)
    other = F.when(arm() == "A", "B").otherwise("A")
    return _rows(
        spark, folder, "events", user_id="user_id", session_date=day("ts"),
        test_group=F.when(wrong, other).otherwise(arm()),
    )


# Scooter rides --------------------------------------------------------------------------------


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """Events as rides of ``value`` minutes."""
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("value") * 60).cast("decimal(18,6)"))
    return _rows(
        spark, folder, "events", order_rk="event_id", party_rk="user_id", transport_model="event_type",
        book_start_dttm="ts", book_end_dttm=F.col("ts") + minutes,
        local_book_start_dttm=F.col("ts") + F.expr("INTERVAL 3 HOURS"), distance_km=pages() / 10,
        minute_cost=half_even(F.col("value") / 10, 1), nominal_price_rub_amt="value",
        activation_cost=F.when(pages() < 20, 0).when(pages() < 60, 30).otherwise(50),
        loyalty_accrual_rub_amt=F.when(pages() > 50, half_even(F.col("value") / 20, 2)),
        loyalty_accrual_bns_amt=F.when(pages() < 30, half_even(F.col("value") / 50, 2)),
    )


def rides(spark: SparkSession, folder: str) -> DataFrame:
    """Rides with the customer's attributes."""
    balance = F.col("c_acctbal")
    people = _rows(
        spark, folder, "customer", party_rk="c_custkey", nation="c_nationkey",
        gender_cd=F.when(balance > 5000, "M").when(balance > 500, "F"),
        education_level_cd=F.when(balance > 1000, F.col("c_mktsegment")),
        marital_status_cd=F.when(balance > 7000, "MAR").when(balance > 2000, "UNM"),
        age=F.when(balance >= 0, F.floor(balance / 200).cast("int") + 12),
    )
    nations = _rows(spark, folder, "nation", nation="n_nationkey", lvn_state_nm="n_name")
    return lookup_join(lookup_join(trips(spark, folder), people, "party_rk"), nations, "nation").drop("nation")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "lineitem")


# Tariffs --------------------------------------------------------------------------------------


def members(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(
        spark, folder, "customer", user_id="c_custkey", name="c_name",
        age=F.floor(F.col("c_acctbal") / 250).cast("int") + 12, city="c_nationkey",
        subscription_type=F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "ultra").otherwise("free"),
    )


def member_rides(spark: SparkSession, folder: str) -> DataFrame:
    """Distance in metres and whole minutes, both read off the order total."""
    price = F.col("o_totalprice")
    return _rows(
        spark, folder, "orders", user_id="o_custkey", date=day("o_orderdate"),
        distance=price.cast("decimal(18,2)"), duration=half_even(price / 10000).cast("int"),
    )


# Start-ups ------------------------------------------------------------------------------------


def companies(spark: SparkSession, folder: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return _rows(
        spark, folder, "customer", company_id="c_custkey", name="c_name", category_code="c_mktsegment",
        status=F.when(balance < 0, "closed").when(balance > 9000, "acquired").when(balance > 8000, "ipo").otherwise("operating"),
        country_code="c_nationkey", investment_rounds=F.when(balance > 7000, 1).otherwise(0),
        funding_rounds=F.when(balance > 1000, F.floor(balance / 2500).cast("int") + 1).otherwise(0),
        funding_total=F.greatest(balance, F.lit(0.0)), milestones=F.floor(F.abs(balance) / 3000).cast("int"),
    )


def company_and_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The denormalised table: every funding round with the columns of its company."""
    rounds = _rows(
        spark, folder, "orders", company_id="o_custkey", funding_round_id="o_orderkey", company_id_rounds="o_custkey",
        funded_at=day("o_orderdate"), funding_round_type="o_orderpriority", raised_amount="o_totalprice",
    )
    joined = lookup_join(rounds, companies(spark, folder), "company_id", "left")
    owner = companies(spark, folder).columns
    return joined.select(*owner, *[c for c in rounds.columns if c != "company_id"])


def acquisitions(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the deals has no stated price (0 or 1)."""
    price = F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice"))
    price = price.when(F.col("o_orderpriority") == "5-LOW", F.lit(1)).otherwise(F.lit(0)).cast("long")
    return _rows(spark, folder, "orders", id="o_orderkey", acquired_company_id="o_custkey", price_amount=price)


def staff(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, "orders", id="o_orderkey", company_id=F.nullif(F.col("o_custkey"), F.lit(0)))


def education(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(
        spark, folder, "lineitem", person_id="l_orderkey",
        instituition=F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")),
    )


# Accidents ------------------------------------------------------------------------------------


def accidents(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice")
    return _rows(
        spark, folder, "orders", id="o_orderkey", datetime="o_orderdate", nearby="o_orderpriority",
        address=F.when((F.col("o_orderstatus") != "P") | (price < 400000), F.col("o_orderstatus")),
        point_lat=half_even(price / 10000, 3), point_long=half_even(price / 7000, 3), category="o_orderstatus",
    )


def accident_drivers(spark: SparkSession, folder: str) -> DataFrame:
    """Years of experience run from 0 past 70."""
    return _rows(
        spark, folder, "lineitem", role="l_returnflag",
        years_of_driving_experience=F.when(F.col("l_linenumber") < 7, (F.col("l_quantity") - 1) * 1.5),
    )
