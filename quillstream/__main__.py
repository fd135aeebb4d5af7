from quillstream.cli import main

raise SystemExit(main())
