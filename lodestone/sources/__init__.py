"""Readers: tables as passages and questions, pages as text, objects in stores."""
