"""Reading documents, pages and providers; writing exports."""
