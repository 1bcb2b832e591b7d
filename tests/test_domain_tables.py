"""The analyses on files with the original column names: declared schemas, gaps, odd values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.plans import accidents, donors, feed, realty, rides, shop, startups, tariffs, vacancies
from tidemark.sources import schemas
from tidemark.sources.tables import cast_columns, parse_times, read_table, reject_counts, small_table, write_table


def csv(spark, folder, name, schema, text):
    path = folder / f"{name}.csv"
    path.write_text(text.strip() + "\n", encoding="utf-8")
    return read_table(spark, str(path), "csv", schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_schema_parses(spark):
    from pyspark.sql.types import StructType

    names = [n for n in dir(schemas) if n.isupper() and n != "GIVEN"]
    assert len(names) == 26
    assert all(len(StructType.fromDDL(getattr(schemas, n))) >= 2 for n in names)


def test_given_tables_have_the_declared_types(spark):
    for name, schema in schemas.GIVEN.items():
        stored = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        assert ", ".join(f"{c} {t}" for c, t in stored.dtypes) == schema


def test_donors(spark, tmp_path):
    users = csv(spark, tmp_path, "users", schemas.DONOR_USERS, """
id,region,confirmed_donations,autho_vk,autho_ok,autho_tg,autho_yandex,autho_google
1,North,5,true,true,,,
2,,0,,,,true,
3,North,,false,,,,
""")
    assert [tuple(r) for r in donors.top_regions(users).collect()] == [("North", 2), (None, 1)]
    assert [r["id"] for r in donors.top_donors(users, 2).collect()] == [3, 1]
    assert rows(donors.channel_priority(users)) == [
        ("Без авторизации через соцсети", 1, None), ("ВКонтакте", 1, 5.0), ("Яндекс", 1, 0.0)
    ]
    bonus = small_table(spark, [(1, 2), (1, 3), (2, 0)], schemas.DONOR_BONUSES)
    assert rows(donors.bonus_effect(users, bonus)) == [("Не получали бонусы", 2, 0.0), ("Получили бонусы", 2, 5.0)]
    assert rows(donors.bonus_effect(users, bonus, distinct=True)) == [
        ("Не получали бонусы", 2, 0.0), ("Получили бонусы", 1, 5.0)
    ]
    donations = csv(spark, tmp_path, "donations", schemas.DONATIONS, """
id,user_id,donation_date
1,1,0201-01-01
2,1,2018-02-04
3,2,2022-01-31
4,2,2023-12-31
""")
    months = donors.donations_per_month(donations, dt.date(2022, 1, 1), dt.date(2023, 12, 31))
    assert rows(months) == [(dt.date(2022, 1, 1), 1), (dt.date(2023, 12, 1), 1)]
    cohorts = donors.repeat_cohorts(donations, F.lit(dt.date(2025, 1, 1)))
    assert [r["first_year"] for r in cohorts.collect()] == [201, 2022]
    assert donors.repeat_cohorts(donations).count() == 2


def test_real_estate(spark, tmp_path):
    flats = csv(spark, tmp_path, "flats", schemas.FLATS, """
id,city_id,type_id,total_area,rooms,ceiling_height,floors_total,living_area,floor,is_apartment,open_plan,kitchen_area,balcony,airports_nearest,parks_around3000,ponds_around3000
a,6X8I,F8EM,40,1,2.6,5,,,,,,,,,
b,6X8I,F8EM,50,,,9,,,,,,1,,,
c,77,F8EM,60,2,2.7,9,,,,,,2,,,
d,77,OTHER,70,2,2.7,9,,,,,,2,,,
e,77,F8EM,500,9,9.0,9,,,,,,9,,,
f,77,F8EM,30,1,2.0,2,,,,,,1,,,
""")
    ads = csv(spark, tmp_path, "ads", schemas.ADVERTISEMENTS, """
id,first_day_exposition,days_exposition,last_price
a,2016-01-10,30,4000000
b,2016-05-01,,5000000
c,2017-01-01,200,3000000
d,2017-01-01,10,3000000
e,2017-01-01,10,9000000
""")
    cities = small_table(spark, [("77", "Town"), ("6X8I", "Main")], schemas.CITIES)
    got = [tuple(r) for r in realty.profile(flats, ads, "6X8I", "F8EM").collect()]
    assert [g[:4] for g in got] == [
        ("Санкт-Петербург", "менее месяца", 1, 100000.0), ("Санкт-Петербург", "Другие", 1, 100000.0),
        ("ЛенОбл", "более полугода", 1, 50000.0),
    ]
    published = realty.seasonality(flats, ads, "F8EM", (2015, 2018), "published")
    assert [tuple(r)[:3] for r in published.collect()] == [(1, "Январь", 2)]
    towns = realty.top_towns(flats, ads, cities, "6X8I").collect()
    assert [tuple(r) for r in towns] == [("Town", 2, 100.0, 46428.57, 65.0, 105.0)]


def test_vacancies(spark, tmp_path):
    table = csv(spark, tmp_path, "vacancies", schemas.VACANCIES, """
name,area,employer,employment,schedule,experience,salary_from,salary_to,key_skills_1,key_skills_2,key_skills_3,key_skills_4,soft_skills_1,soft_skills_2,soft_skills_3,soft_skills_4
Аналитик данных,Москва,A,full,day,Junior,100.5,,SQL,,,, Умение,,,
Старший Системный аналитик,Москва,A,full,day,Middle,,200,SQL,Python,,,,,,
аналитик данных,Тверь,B,part,day,Junior,50,60,,,,,,,,
""")
    assert rows(vacancies.title_count(table)) == [(2,)]
    assert rows(vacancies.experience_share(table)) == [("Junior", 1, 50.0), ("Middle", 1, 50.0)]
    assert rows(vacancies.employer_profile(table)) == [("A", "full", "day", 2, 100.5, 200.0)]
    assert vacancies.salary_summary(table).first()["avg_salary_from"] == 75.25
    assert ("key_skills_1", "SQL", 2) in rows(vacancies.skill_mentions(table))
    assert rows(vacancies.vacancies_by(table, "area")) == [("Москва", 2), ("Тверь", 1)]


def test_shop_experiment(spark, tmp_path):
    users = csv(spark, tmp_path, "users", schemas.SHOP_USERS, """
user_id,first_date,region,device
u1,2025-06-01,EU,PC
u2,2025-06-02,EU,Mac
u3,2025-06-01,CIS,PC
u9,2025-06-01,CIS,PC
""")
    sales = csv(spark, tmp_path, "sales", schemas.SHOP_PURCHASES, """
user_id,event_dt,revenue
u1,2025-06-03 10:00:00,5.5
u1,2025-06-04 23:59:59,1
u9,2025-06-03 10:00:00,5.5
""")
    people = small_table(spark, [("u1", "A", "t"), ("u2", "A", "t"), ("u3", "B", "t"), ("u9", "B", "x")], schemas.SHOP_PARTICIPANTS)
    assert rows(shop.region_mix(users, people, "t")) == [("CIS", 1, 0.333333), ("EU", 2, 0.666667)]
    assert rows(shop.conversion(sales, users, people, "t")) == [("A", 1, 2, 0.5), ("B", None, 1, None)]
    assert rows(shop.cumulative_rows(sales, people, "t", "event_dt"))[-1] == ("A", dt.date(2025, 6, 4), 1, 2)
    assert rows(shop.cumulative_registrations(users, people, "t"))[1] == ("A", dt.date(2025, 6, 2), 1, 2)
    assert shop.conversion_test(sales, users, people, "t").first()["x_b"] == 0


def test_feed_sessions(spark, tmp_path):
    sessions = csv(spark, tmp_path, "sessions", schemas.FEED_TEST_SESSIONS, """
user_id,session_id,session_date,session_start_ts,install_date,session_number,registration_flag,page_counter,region,device,test_group
u1,s1,2025-10-01,2025-10-01 10:00:00,2025-10-01,1,1,4,MENA,iPhone,A
u1,s2,2025-10-02,2025-10-02 10:00:00,2025-10-01,2,0,,MENA,iPhone,A
u2,s3,2025-10-01,2025-10-01 10:00:00,2025-10-01,1,0,3,CIS,PC,B
u3,s4,2025-10-02,2025-10-02 10:00:00,2025-10-02,1,0,9,CIS,PC,B
""")
    assert rows(feed.good_share_per_day(sessions)) == [(dt.date(2025, 10, 1), 1, 2, 0.5), (dt.date(2025, 10, 2), 1, 2, 0.5)]
    assert rows(feed.mean_good_share(sessions)) == [(0.5,)]
    assert rows(feed.registrations_per_day(sessions))[0] == (dt.date(2025, 10, 1), 1, 2, 0.5)
    assert [r["session_id"] for r in feed.busiest_user(sessions).orderBy("session_id").collect()] == ["s1", "s2"]
    assert rows(feed.first_day_balance(sessions)) == [(dt.date(2025, 10, 1), 1, 1, 0.0)]
    assert rows(feed.page_counts(sessions)) == [(3, 1), (4, 1), (9, 1)]


def test_scooter_rides(spark, tmp_path):
    table = csv(spark, tmp_path, "rides", schemas.SCOOTER_RIDES, """
order_rk,party_rk,minute_cost,hold_amount,transport_model,activation_cost,distance_km,created_dttm,book_start_dttm,book_end_dttm,book_time_zone_cd,local_book_start_dttm,nominal_price_rub_amt,loyalty_accrual_rub_amt,loyalty_accrual_bns_amt,gender_cd,age,education_level_cd,marital_status_cd,lvn_state_nm
1,7,8,300,M1,50,2.5,2024-07-01 09:00:00,2024-07-01 09:00:00,2024-07-01 09:10:30,2,2024-07-01 12:00:00,130,5,,M,18,GRD,,Tver
2,7,7,300,M1,50,1.5,2024-07-02 21:30:00,2024-07-02 21:30:00,2024-07-02 21:41:30,2,2024-07-03 00:30:00,90,,,M,18,GRD,,Tver
3,8,9,300,M2,30,,2024-07-01 09:00:00,2024-07-01 09:00:00,2024-07-01 09:20:00,2,2024-07-01 12:00:00,210,,2,,,,,
""")
    assert rows(rides.quality(table)) == [(12, 2, 0)]
    assert rows(rides.riders_by(table, "gender_cd")) == [("M", 1, 0.5), ("No info", 1, 0.5)]
    assert [r["order_rk"] for r in rides.one_ride_per_rider(table).orderBy("party_rk").collect()] == [1, 3]
    assert [r["rides"] for r in rides.age_table(table).collect()] == [2, None, None, None, None, 1]
    assert rows(rides.rides_per_value(table, "duration_min")) == [(10, 1), (12, 1), (20, 1)]
    weekdays = rides.seasonality(table, "weekday").collect()
    assert [(r["weekday"], r["rides"]) for r in weekdays][:3] == [("Monday", 2), ("Tuesday", None), ("Wednesday", 1)]
    assert rows(rides.has_cashback(table, "loyalty_accrual_rub_amt")) == [(False, 2, 66.666667), (True, 1, 33.333333)]


def test_tariffs(spark, tmp_path):
    users = csv(spark, tmp_path, "users", schemas.MEMBERS, """
user_id,name,age,city,subscription_type
1,Ann,17,Omsk,ultra
1,Ann,17,Omsk,ultra
2,Bob,,Omsk,free
""")
    trips = csv(spark, tmp_path, "trips", schemas.MEMBER_RIDES, """
user_id,distance,duration,date
1,1000.0,10.5,2021-01-05
1,1000.0,10.5,2021-01-05
1,,11.5,2021-02-05
2,500.0,20.0,2021-01-05
""")
    prices = tariffs.tariff_table(spark, [("free", 8, 50, 0), ("ultra", 6, 0, 199)])
    clean = tariffs.cleaned_rides(trips)
    assert rows(clean.select("user_id", "distance", "duration", "month")) == [(1, 0.0, 12, 2), (1, 1000.0, 10, 1), (2, 500.0, 20, 1)]
    assert rows(tariffs.cleaning_report(trips)) == [(1, 4, 1)]
    assert rows(tariffs.minors_share(users.dropDuplicates())) == [(2, 1, 50)]
    revenue = tariffs.monthly_revenue(users, clean, prices)
    assert {(r["user_id"], r["month"]): r["monthly_revenue"] for r in revenue.collect()} == {(1, 1): 259, (1, 2): 271, (2, 1): 210}
    assert {r["user_id"] for r in tariffs.best_customer(revenue).collect()} == {1}


def test_startups(spark, tmp_path):
    head = (
        "company  ID,name,category  code,status,founded  at,closed  at,domain,network  username,country  code,"
        "investment  rounds,funding  rounds,funding  total,milestones,funding  round  id,company  id  rounds,funded  at,"
        "funding  round  type,raised  amount,pre  money  valuation,participants,is  first  round,is  last  round"
    )
    raw_schema = ", ".join(f"`{c}` string" for c in head.split(","))
    raw = csv(spark, tmp_path, "rounds", raw_schema, head + """
1,Acme,web,acquired,2001-01-01,,,acme,USA,0,2,100,3,10,1,2005-01-01,angel,40,,1,0,1
1,Acme,web,acquired,2001-01-01,,,acme,USA,0,2,100,3,11,1,2006-01-01,angel,60,,1,1,0
2,Beta,bio,operating,2001-01-01,,,,USA,0,0,0,1,,,,,,,,,
,,,,,,,,,,,,,12,9,2006-01-01,angel,10,,1,1,1
""")
    table = cast_columns(startups.repaired(raw), {"company_id": "bigint", "funding_rounds": "int", "investment_rounds": "int", "funding_total": "bigint", "raised_amount": "bigint"})
    table = parse_times(table, {"funded_at": "yyyy-MM-dd"}, to="date")
    owners, parts = startups.split_rounds(table)
    assert (owners.count(), parts.count()) == (2, 3)
    assert rows(startups.rounds_per_year(table, at_least=1)) == [(2006, 2, 35.0)]
    assert [r["company_id"] for r in startups.of_interest(owners).collect()] == [1]
    deals = small_table(spark, [(1, 5, 1, None, 0, None), (2, 5, 2, None, 0, None)], schemas.ACQUISITIONS)
    assert rows(startups.unpriced_summary(startups.unpriced_deals(owners, deals))) == [(0, 1, 100.0)]
    people = small_table(spark, [(1, "a", "b", 1, None), (2, "c", "d", 1, "acme"), (3, "e", "f", None, None)], schemas.PEOPLE)
    school = small_table(spark, [(1, 1, "MIT", None), (2, 1, None, None)], schemas.EDUCATION)
    assert rows(startups.education_by_size(people, school)) == [("2", 100.0, 1)]


def test_accidents(spark, tmp_path):
    schema = "id bigint, `properties.datetime` timestamp_ntz, `properties.nearby` string, `properties.address` string, `properties.point.lat` double, `properties.point.long` double"
    table = accidents.renamed(csv(spark, tmp_path, "dtp", schema, """
id,properties.datetime,properties.nearby,properties.address,properties.point.lat,properties.point.long
1,2024-01-01 10:00:00,school,,58.123,49.5
2,2024-01-02 10:00:00,school,Street 1,58.123,49.5
3,2023-01-02 10:00:00,park,Street 2,58.123,50.0
4,2023-01-02 10:00:00,,Street 3,,
"""))
    assert table.columns == ["id", "datetime", "nearby", "address", "point_lat", "point_long"]
    assert rows(accidents.missing_address_places(table)) == [("school", 1)]
    assert [r["id"] for r in accidents.near_missing_addresses(table).orderBy("id").collect()] == [1, 2]
    assert rows(accidents.by_weekday(table)) == [("Monday", 3), ("Tuesday", 1)]
    people = accidents.population_table(spark, [(2023, 13), (2024, 12)])
    assert rows(accidents.per_100k(table, people)) == [(2023, 2, 13, 0.15), (2024, 2, 12, 0.17)]
    drivers = small_table(spark, [(0.0,), (10.0,), (10.5,), (71.0,), (None,)], "years_of_driving_experience double")
    assert [r["n"] for r in accidents.experience_bins(drivers, accidents.DECADES).collect()] == [1, 1, 0, 0, 0, 0, 0]


def test_broken_records_stop_the_read_unless_tolerated(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("user_id,user_bonus_count\n1,x\n2,3\n")
    with pytest.raises(Exception):
        read_table(spark, str(path), "csv", schemas.DONOR_BONUSES).collect()
    assert rows(read_table(spark, str(path), "csv", schemas.DONOR_BONUSES, tolerant=True)) == [(1, None), (2, 3)]
    with pytest.raises(ValueError):
        read_table(spark, str(path), "csv")
    text = read_table(spark, str(path), "csv", "user_id string, user_bonus_count string")
    assert rows(reject_counts(text, {"user_id": "int", "user_bonus_count": "int"})) == [(0, 1)]
    assert rows(cast_columns(text, {"user_bonus_count": "int"}, tolerant=True)) == [("1", None), ("2", 3)]


def test_written_tables_read_back_and_are_not_replaced(spark, tmp_path):
    df = small_table(spark, [(1, 2), (2, 3)], schemas.DONOR_BONUSES)
    for fmt in ("parquet", "csv", "json", "orc"):
        path = str(tmp_path / fmt)
        write_table(df, path, fmt)
        assert rows(read_table(spark, path, fmt, schemas.DONOR_BONUSES)) == [(1, 2), (2, 3)]
        with pytest.raises(Exception):
            write_table(df, path, fmt)


def test_bad_times(spark):
    df = small_table(spark, [("2024-01-02 03:04:05",), ("never",)], "t string")
    tolerant = parse_times(df, {"t": "yyyy-MM-dd HH:mm:ss"}, tolerant=True)
    assert rows(tolerant) == [(None,), (dt.datetime(2024, 1, 2, 3, 4, 5),)]
    with pytest.raises(Exception):
        parse_times(df, {"t": "yyyy-MM-dd HH:mm:ss"}).collect()
