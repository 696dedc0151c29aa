"""Set-oriented operators over pages, documents, links and fetch events."""
