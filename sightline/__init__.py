"""Exploratory data analysis, cleaning and model advice on Spark DataFrames."""

from sightline.functions.tablestats import TableStats
from sightline.operators import (advice, anomaly, charts, cleaning, correlation, distribution, filters, groups,
                                 hypothesis, models, overview, quality, transforms, typing)
from sightline.plans import cleaning_plan, dashboard, profile
from sightline.sources import export, load

__all__ = ["TableStats", "advice", "anomaly", "charts", "cleaning", "cleaning_plan", "correlation", "dashboard",
           "distribution", "export", "filters", "groups", "hypothesis", "load", "models", "overview", "profile",
           "quality", "transforms", "typing"]
