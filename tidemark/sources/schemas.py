"""Declared schemas of the input tables, as DDL text for ``read_table(..., schema=...)``."""

DONOR_USERS = (
    "id bigint, region string, confirmed_donations int, autho_vk boolean, autho_ok boolean, "
    "autho_tg boolean, autho_yandex boolean, autho_google boolean"
)
DONATIONS = "id bigint, user_id bigint, donation_date date"
DONOR_BONUSES = "user_id bigint, user_bonus_count int"
DONATION_PLAN = "user_id bigint, donation_date date, donation_type string"

FLATS = (
    "id string, city_id string, type_id string, total_area double, rooms int, ceiling_height double, "
    "floors_total double, living_area double, floor int, is_apartment int, open_plan int, kitchen_area double, "
    "balcony double, airports_nearest double, parks_around3000 int, ponds_around3000 int"
)
ADVERTISEMENTS = "id string, first_day_exposition date, days_exposition double, last_price double"
CITIES = "city_id string, city string"

VACANCIES = (
    "name string, area string, employer string, employment string, schedule string, experience string, "
    "salary_from decimal(18,2), salary_to decimal(18,2), "
    "key_skills_1 string, key_skills_2 string, key_skills_3 string, key_skills_4 string, "
    "soft_skills_1 string, soft_skills_2 string, soft_skills_3 string, soft_skills_4 string"
)

SHOP_USERS = "user_id string, first_date date, region string, device string"
SHOP_SESSIONS = "user_id string, session_start date, session_duration double"
SHOP_PURCHASES = "user_id string, event_dt timestamp_ntz, revenue double"
SHOP_PARTICIPANTS = "user_id string, `group` string, ab_test string"

FEED_SESSIONS = (
    "user_id string, session_id string, session_date date, session_start_ts timestamp_ntz, install_date date, "
    "session_number int, registration_flag int, page_counter int, region string, device string"
)
FEED_TEST_SESSIONS = FEED_SESSIONS + ", test_group string"

SCOOTER_RIDES = (
    "order_rk bigint, party_rk bigint, minute_cost double, hold_amount double, transport_model string, "
    "activation_cost double, distance_km double, created_dttm timestamp_ntz, book_start_dttm timestamp_ntz, "
    "book_end_dttm timestamp_ntz, book_time_zone_cd int, local_book_start_dttm timestamp_ntz, "
    "nominal_price_rub_amt double, loyalty_accrual_rub_amt double, loyalty_accrual_bns_amt double, "
    "gender_cd string, age int, education_level_cd string, marital_status_cd string, lvn_state_nm string"
)

MEMBERS = "user_id bigint, name string, age int, city string, subscription_type string"
MEMBER_RIDES = "user_id bigint, distance double, duration double, date date"
TARIFFS = "subscription_type string, minute_price int, start_ride_price int, subscription_fee int"

ACQUISITIONS = (
    "id bigint, acquiring_company_id bigint, acquired_company_id bigint, term_code string, "
    "price_amount bigint, acquired_at date"
)
COMPANY_AND_ROUNDS = (
    "company_id bigint, name string, category_code string, status string, founded_at date, closed_at date, "
    "domain string, network_username string, country_code string, investment_rounds int, funding_rounds int, "
    "funding_total bigint, milestones int, funding_round_id bigint, company_id_rounds bigint, funded_at date, "
    "funding_round_type string, raised_amount bigint, pre_money_valuation bigint, participants int, "
    "is_first_round int, is_last_round int"
)
PEOPLE = "id bigint, first_name string, last_name string, company_id bigint, network_username string"
EDUCATION = "id bigint, person_id bigint, instituition string, graduated_at date"
DEGREES = "id bigint, object_id string, degree_type string, subject string"

ACCIDENTS = (
    "`geometry.coordinates` string, id bigint, `properties.tags` string, `properties.light` string, "
    "`properties.point.lat` double, `properties.point.long` double, `properties.nearby` string, "
    "`properties.region` string, `properties.scheme` string, `properties.address` string, "
    "`properties.weather` string, `properties.category` string, `properties.datetime` timestamp_ntz, "
    "`properties.injured_count` int, `properties.parent_region` string, `properties.road_conditions` string, "
    "`properties.participants_count` int, `properties.participant_categories` string"
)
ACCIDENT_PARTICIPANTS = (
    "role string, gender string, violations string, health_status string, "
    "years_of_driving_experience double, id bigint"
)
ACCIDENT_VEHICLES = "year int, brand string, color string, model string, category string, id bigint"

# The given tables the stand-ins are read from.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}
