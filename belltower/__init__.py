"""Belltower: contact-centre and document analytics as Spark jobs."""
