"""folioscope: document retrieval, catalog and corpus analytics as DataFrame programs."""
