"""Canonical tables, as DDL. Readers, operators and fixtures share these types; amounts are doubles, days are dates."""

from __future__ import annotations

#: One row a tender; ``main`` marks the kept version, ``doubtful`` an unreliable date.
TENDERS = (
    "ref string, buyer string, sort_date string, doubtful boolean, estimation double, winner_key string, reference_price double, n_lots int, main boolean, unsuccessful boolean, title string, reference string, deposit double"
)
#: One row a bid, ``id`` in order of deposit; ``lots`` names the lots it is for, comma-separated.
BIDS = ("id long, ref string, bidder string, bidder_key string, amount_deed double, amount_checked double, status string, lots string")
LOTS = ("ref string, lot string, estimation double, winner_key string, reference_price double, title string, deposit double, classes string")
QUALIFICATIONS = ("ref string, sector string, domain string, qualification string, class string, raw string")
#: Open tenders; ``raw`` is the pushed JSON text with whatever fields it had.
OPEN_TENDERS = (
    "notice_ref string, org string, reference string, title string, buyer string, buyer_key string, published string, closing string, estimation double, deposit double, place string, url string, source string, received timestamp, updated timestamp, raw string"
)
OPEN_CLIENTS = ("notice_ref string, client string, added timestamp")
OPEN_LOTS = ("notice_ref string, lot string, title string, estimation double, deposit double")
OPEN_QUALIFICATIONS = ("notice_ref string, label string, class string")

#: Statuses of a bid that was not eliminated.
ADMITTED = ("admis", "attributaire", "retenu")
#: Amounts of nothing or beyond this are misread.
AMOUNT_CAP = 5e9
