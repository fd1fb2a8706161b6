"""Spark-native document conversion: notebooks to tables, tables to Markdown, HTML, vault notes and note-exchange XML."""
