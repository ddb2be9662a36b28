"""The generator's settings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


def names(text: str) -> tuple[str, ...]:
    return tuple(text.split(","))


@dataclass(frozen=True)
class GeneratorConfig:
    """Settings of the event generator; the option of each is its name with dashes."""

    events_per_second: int = 1_000
    active_people: int = 1_000
    in_flight_auctions: int = 100
    out_of_order_group_size: int = 1
    hot_seller_ratio: int = 4
    hot_auction_ratio: int = 2
    hot_bidder_ratio: int = 4
    hot_seller_ratio_2: int = 100
    hot_auction_ratio_2: int = 100
    hot_bidder_ratio_2: int = 100
    first_event_id: int = 0
    first_event_number: int = 0
    num_categories: int = 5
    first_category_id: int = 10
    auction_id_lead: int = 10
    person_id_lead: int = 10
    person_proportion: int = 1
    auction_proportion: int = 3
    bid_proportion: int = 46
    first_auction_id: int = 1_000
    first_person_id: int = 1_000
    base_time: int = 0  # ns
    threads: int = 1
    us_states: tuple[str, ...] = names("AZ,CA,ID,OR,WA,WY")
    us_cities: tuple[str, ...] = names("phoenix,los angeles,san francisco,boise,portland,bend,redmond,seattle,kent,cheyenne")

    @classmethod
    def of(cls, options: Mapping[str, object]) -> GeneratorConfig:
        """From options by name with dashes; others are ignored, values that can't be read are refused.

        ``first-event-rate`` stands for ``events-per-second``; a later rate has to be the same.
        """
        found = {}
        for f in fields(cls):
            if (value := options.get(f.name.replace("_", "-"))) is not None:
                found[f.name] = names(str(value)) if isinstance(f.default, tuple) else int(value)
        rate = int(options.get("first-event-rate", found.get("events_per_second", cls.events_per_second)))
        if int(options.get("next-event-rate", rate)) != rate:
            raise ValueError("only a constant rate is supported")
        return cls(**found | {"events_per_second": rate})

    @property
    def denominator(self) -> int:
        return self.person_proportion + self.auction_proportion + self.bid_proportion

    @property
    def delay_ns(self) -> float:
        return 1e9 / self.events_per_second * self.threads
