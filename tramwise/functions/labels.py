"""Classifications that turn measures and codes into words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: texts and limits of the classifications
NORMAL_SERVICE = "Normal Service"
SEATS_LEFT = "Seat available! Proceed to book."
NO_SEATS_LEFT = "Sorry, no seats left."


def delay_category(delay: Column) -> Column:
    """Four bands by minutes late; an unknown delay falls in the last."""
    return (
        F.when(delay <= 0, "On Time")
        .when(delay <= 5, "Slight Delay")
        .when(delay <= 15, "Moderate Delay")
        .otherwise("Severe Delay")
    )


def service_state(reason: Column, operational: Column, delay: Column) -> Column:
    """A maintenance reason wins; then running late, running, not running."""
    return (
        F.when(reason.contains("Maintenance"), "Maintenance")
        .when(operational & (delay > 0), "Delayed")
        .when(operational, "Active")
        .otherwise("Out of Service")
    )


def traffic_light(mean_delay: Column) -> Column:
    return (
        F.when(mean_delay < 5, "green")
        .when(mean_delay < 10, "yellow")
        .otherwise("red")
    )


def card_type(number: Column) -> Column:
    """Card type from the last two digits of the running number."""
    band = F.pmod(number, F.lit(100))
    return (
        F.when(band < 65, "Regular")
        .when(band < 85, "Student")
        .when(band < 95, "Senior")
        .otherwise("Accessibility")
    )


def card_number(number: Column) -> Column:
    """``CARD_`` and the running number, padded to six digits.

    Longer numbers are kept whole: padding must not cut them.
    """
    text = number.cast("string")
    width = F.greatest(F.length(text), F.lit(6))
    return F.concat(F.lit("CARD_"), F.lpad(text, width, F.lit("0")))


def line_mode(code: Column) -> Column:
    """Short line codes are metro lines, longer ones buses."""
    return F.when(F.length(code) <= 2, "Metro").otherwise("Bus")


def booking_message(seats_left: Column) -> Column:
    return F.when(seats_left > 0, SEATS_LEFT).otherwise(NO_SEATS_LEFT)
