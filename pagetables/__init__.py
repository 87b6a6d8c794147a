"""Web pages to tables and Markdown, traffic analysis, and crawl jobs on Spark."""
