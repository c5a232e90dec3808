"""Ordered substring rules that sort domains and links into classes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.functions.text import strip


def _contains_any(text: Column, marks) -> Column:
    return reduce(or_, [text.contains(mark) for mark in marks])


def normal_domain(domain: Column) -> Column:
    return F.coalesce(F.lower(strip(domain)), F.lit(""))


def normal_link(url: Column) -> Column:
    return F.coalesce(F.lower(url), F.lit(""))


def categorize_domain(domain: Column) -> Column:
    """Content category of a domain. A missing domain counts as an external link."""
    return category_of(normal_domain(domain))


def category_of(text: Column) -> Column:
    """Content category of a domain in normal form."""
    rule = F.when(
        text.startswith(fv.SELF_PREFIX) | _contains_any(text, fv.SELF_MARKS), fv.CATEGORY_SELF
    )
    for label, marks in fv.CATEGORY_MARKS:
        rule = rule.when(_contains_any(text, marks), label)
    return rule.otherwise(fv.CATEGORY_OTHER)


def detect_media_type(url: Column) -> Column:
    """Media type of a link. A missing link counts as a link to an article."""
    return media_type_of(normal_link(url))


def media_type_of(text: Column) -> Column:
    """Media type of a link in normal form."""
    (first, first_marks), *others = fv.MEDIA_MARKS
    rule = F.when(_contains_any(text, first_marks), first)
    for label, marks in others:
        rule = rule.when(_contains_any(text, marks), label)
    discussion = reduce(lambda a, b: a & b, [text.contains(m) for m in fv.MEDIA_TEXT_MARKS])
    return rule.when(discussion, fv.MEDIA_TEXT).otherwise(fv.MEDIA_OTHER)
