from datetime import date, datetime
from decimal import Decimal

from conftest import rows

from tramwise.operators import ridership


def trip(number, card, route, at, fare="2.50", **more):
    at = datetime.fromisoformat(at)
    return {
        "trip_id": number,
        "card_id": card,
        "route_id": route,
        "tap_in_time": at,
        "tap_out_time": at,
        "fare_paid": None if fare is None else Decimal(fare),
        "trip_date": at.date(),
        **more,
    }


def test_cards(make):
    cards = [
        {"card_id": 1, "card_type": "Regular", "total_trips": 0},
        {
            "card_id": 2,
            "card_type": "Senior",
            "total_trips": 5,
            "last_used": date(1999, 1, 1),
        },
    ]
    t = make(
        fare_cards=cards,
        trips=[
            trip(1, 1, 1, "2000-01-01 07:10:00"),
            trip(2, 1, 1, "2000-01-03 09:10:00", fare=None),
        ],
    )
    usage = {r["card_type"]: r for r in rows(ridership.card_type_usage(t))}
    assert usage["Senior"]["total_cards"] == 1
    assert usage["Senior"]["total_trips"] == 0
    assert usage["Senior"]["total_revenue"] is None
    assert usage["Regular"]["total_trips"] == 2
    statistics = rows(ridership.card_statistics(t).orderBy("card_id"))
    assert statistics == [
        {"card_id": 1, "total_trips": 2, "last_used": date(2000, 1, 3)},
        {"card_id": 2, "total_trips": 5, "last_used": date(1999, 1, 1)},
    ]
    fresh = ridership.refreshed_fare_cards(t)
    assert fresh.columns == t.fare_cards.columns
    assert dict(fresh.dtypes) == dict(t.fare_cards.dtypes)
    assert fresh.count() == 2


def test_days_and_hours(make, network):
    t = network.with_(
        **make(
            trips=[
                trip(1, 1, 1, "2000-01-01 07:10:00", fare="1.00"),
                trip(2, 1, 1, "2000-01-01 19:10:00", fare="2.00"),
                trip(3, 2, 2, "2000-01-03 07:59:59", fare="4.00"),
            ]
        ).present()
    )
    days = rows(ridership.daily_ridership(t))
    assert [r["trip_date"].day for r in days] == [3, 1]
    assert days[1]["total_trips"] == 2 and days[1]["unique_riders"] == 1
    assert days[1]["total_revenue"] == Decimal("3.00") and days[1]["avg_fare"] == 1.5
    hours = rows(ridership.peak_hour_analysis(t))
    assert [(r["hour"], r["trip_count"]) for r in hours] == [(7, 2), (19, 1)]
    assert [r["is_peak_hour"] for r in rows(ridership.peak_flag(t).orderBy("trip_id"))] == [True, False, True]
    seed = ridership.peak_flag(t, hours=(7, 8, 9, 17, 18, 19))
    assert all(r["is_peak_hour"] for r in rows(seed))
    assert [r["is_weekend"] for r in rows(ridership.weekend_flag(t))] == [True, False]
    assert [r["day"].day for r in rows(ridership.calendar(t))] == [1, 2, 3]
    performance = {r["route_id"]: r for r in rows(ridership.route_performance(t))}
    assert performance[3]["total_trips"] == 0
    assert performance[3]["total_revenue"] is None
    assert performance[1]["unique_riders"] == 1


def test_card_numbers(make):
    numbers = [7, 65, 85, 95, 1234567]
    t = make(fare_cards=[{"card_id": n} for n in numbers])
    found = rows(ridership.fare_card_numbers(t).orderBy("card_id"))
    assert [r["card_number"] for r in found] == [
        "CARD_000007",
        "CARD_000065",
        "CARD_000085",
        "CARD_000095",
        "CARD_1234567",
    ]
    assert [r["card_type"] for r in found][:4] == [
        "Regular",
        "Student",
        "Senior",
        "Accessibility",
    ]
