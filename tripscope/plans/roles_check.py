"""The five typed relations, each as a whole projection (the tables every later query reads)."""

from __future__ import annotations

from tripscope.plans.registry import Book
from tripscope.plans.role_sql import with_roles
from tripscope.sources import roles

BOOK = Book()

LEG_COLUMNS = [*roles._LEG_BASE, *roles._LEG_DERIVED]
BILL_COLUMNS = [*roles._BILL_BASE, *roles._BILL_DERIVED]
ALERT_COLUMNS = [c for c in (*roles._ALERT_BASE, *roles._ALERT_DERIVED) if not c.endswith("_time")]
FEEDBACK_COLUMNS = [*roles._FB_BASE, *roles._FB_DERIVED]

for _name, _maker, _cols in (
    ("trips", roles.trips, roles.TRIP_COLUMNS),
    ("legs", roles.legs, LEG_COLUMNS),
    ("bills", roles.bills, BILL_COLUMNS),
    ("alerts", roles.alerts, ALERT_COLUMNS),
    ("feedback", roles.feedback, FEEDBACK_COLUMNS),
):
    BOOK.add(
        f"S4_relation_{_name}",
        lambda spark, sf, m=_maker, c=tuple(_cols): m(spark, sf, *c),
        with_roles(f"SELECT {', '.join(_cols)} FROM {_name}", _name),
    )
