"""Paragraphs of public licences, licence-like notices of no family, and plain text that shares words with them."""

from __future__ import annotations

PLAIN = "plain"
UNKNOWN = "unknown"

# Paragraphs and notices of public licences, as they are used in the wild.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3, as published by the Free Software Foundation."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("GPL", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC0", "SPDX-License-Identifier: CC0-1.0"),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so."),
    ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
]

# Licence-like text of no family above, and plain text that shares words with licences.
OTHERS = [
    (UNKNOWN, "Licensed under the terms of the custom license agreement that comes with this product."),
    (UNKNOWN, "This document is licensed under the Example Source License, version 1. All other rights are reserved by the licensor."),
    (UNKNOWN, "You may use this material under the license terms of the publisher only; redistribution is not permitted without written permission."),
    (UNKNOWN, "Released under a proprietary license. Copying and distribution of this file are prohibited."),
    (PLAIN, "She renewed her driving license in the spring and the clerk asked for a copy of the form."),
    (PLAIN, "The council granted permission to build, free of charge, under the general terms of the plan."),
    (PLAIN, "The museum has the right to show the work to the public, and the author will read from version two."),
    (PLAIN, "Common people created new software for the library, and any later visitor could use it at will."),
    (UNKNOWN, "This file is made available under the terms of the vendor license agreement, version 2. See the accompanying license file for details."),
    (UNKNOWN, "Use, duplication and disclosure of this software are subject to the restrictions of the licence agreement. All rights reserved."),
    (UNKNOWN, "Distributed under the terms of the Community License. You may obtain a copy of the license from our site."),
    (UNKNOWN, "The licensee may copy and distribute this program under this licence, provided that the copyright notice is kept in every copy."),
    (UNKNOWN, "Copyright the authors. All rights reserved. No part may be reproduced or redistributed without prior written permission of the copyright owner."),
    (UNKNOWN, "This software is provided without warranty of any kind and the licensor is not liable for damages under this license."),
    (UNKNOWN, "Licensed under the Open Source Licence, version 1.1, as published by its steward. This licence applies to the work and to derivative works."),
    (UNKNOWN, "These materials are made available under the terms of the Public License, which accompanies this distribution."),
    (UNKNOWN, "SPDX-License-Identifier: LicenseRef-Custom"),
    (UNKNOWN, "SPDX-License-Identifier: LicenseRef-Proprietary"),
    (UNKNOWN, "SPDX-License-Identifier: LicenseRef-Internal"),
    (UNKNOWN, "SPDX-License-Identifier: Other"),
    (UNKNOWN, "SPDX-License-Identifier: Vendor-2.1"),
    (UNKNOWN, "SPDX-License-Identifier: Public-1.1"),
    (PLAIN, "Subject to the terms of this Agreement the seller shall deliver the goods and the buyer shall pay the price within thirty days."),
    (PLAIN, "The tenant may use the garden for any purpose, subject to the following conditions of the lease."),
    (PLAIN, "In no event shall the train leave before noon, and any claim for damages goes to the carrier."),
    (PLAIN, "The shop holds a fishing license and sells the permits that the county requires by law."),
    (PLAIN, "The warranty of the kettle covers two years of use, and the copy of the receipt is needed for it."),
    (PLAIN, "The film was distributed in the hope that it would be useful to schools, without the names of its authors."),
    (PLAIN, "A poem may be either read or sung, and the rights of the reader include the use of its form."),
]


# Words that speak of licences; features of their own beside the word pairs.
LICENCE_WORDS = [
    "copyright", "derivative", "disclaimer", "disclaims", "endorse", "infringement", "liable", "liability", "licence",
    "license", "licensed", "licensee", "licenses", "licensor", "merchantability", "noninfringement", "permission",
    "public", "published", "redistribute", "redistributed", "redistribution", "redistributions", "released", "reserved",
    "rights", "software", "source", "spdx-license-identifier", "sublicense", "terms", "version", "warranties", "warranty",
]
# Paragraphs of the corpus with one of these are not taught as plain text: they may be notices.
TELLING = [
    "copyright", "licence", "license", "licensed", "licensee", "licensor", "redistribute", "redistribution",
    "spdx-license-identifier", "sublicense", "warranties", "warranty",
]
